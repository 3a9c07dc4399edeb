"""Main text of web pages, with site templates removed by counting subtrees per host.

A page is parsed once into a flat tree. Subtrees are hashed and counted per host in Spark, over distinct pages. What
recurs on many pages of its host is template and is deleted first, with lists most of whose text is template. The article is
then chosen from what is left and written block by block. Elements that by tag, role or state are never
article text go too; names of classes and ids only decide where counting cannot, that is for containers that say of themselves
that they are furniture (``_named_furniture``).

Text blocks inside an article or main element are never taken for template: passages that
many articles share are still their text. Nor is a subtree that holds most of its page, or one of a host of
fewer than ``MIN_PAGES`` distinct pages, which cannot show what recurs.

Defined results: a null or empty page gives an empty text; repeated rows are extracted row by
row, and equal pages count as one; a null address is a host of its own; broken or unclosed markup is repaired as browsers
roughly do, in time linear in the page; very long pages are read whole; a subtree exactly at the threshold is template; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import slices, spool

#: A subtree is template if half the pages of its host have it, or so many of them, or this share where that is more; on three pages at least.
MIN_PAGES, MANY_PAGES, MIN_SHARE = 3, 6, 0.01
#: Template keys that a worker holds at a time, of 8 bytes each; of more, pages are joined to theirs.
HELD_KEYS = 1_000_000

# Elements and names of the markup language and of common page furniture.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption td th tr".split())
_CONTAINER = frozenset("div section ul ol dl table span center details figure fieldset header hgroup article".split())
_DROP = frozenset("head script style nav footer aside form button select input textarea iframe noscript template svg canvas object audio video map dialog menu title noembed noframes".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Names of furniture that is prose, and of furniture that is links.
_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr login masthead modal newsletter notice notification popup promo promoted promotion replies respond responses sidebar signup sponsor sponsored subscribe subscription topbar".split())
_LINK_NAMES = frozenset("breadcrumb breadcrumbs menu nav navbar navigation pager pagination recommended related search share sharebar sharing skip social toolbar widget widgets".split())
#: Words that say nothing of what a container holds, so that a name may have them beside one of the above.
_PLAIN = frozenset("area bar block body bottom box buttons center container content footer form global head header holder inner items left link links list main outer page panel policy post posts right section site slot text thread top unit wrap wrapper".split())
_MAIN_NAMES = frozenset("article content entry post story main body text".split())
_CLOSES_P = _BLOCK - {"body", "html", "caption", "legend", "summary", "tbody", "tfoot", "thead", "tr"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
_FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "p": ("article", "section", "div", "li", "td", "th", "blockquote", "body", "main", "aside", "nav", "header", "footer", "figure", "form", "button", "dd", "details")}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |</?[a-zA-Z][^\s/>]*+(?:[\s/]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|[^\s/>=]++)*+>
    |</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""",
    re.S | re.X,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WANTED = re.compile(r"(?i)class|id|role|hidden|style|itemprop")
_KEPT = frozenset("class id role hidden style aria-hidden itemprop".split())
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSE_RAW = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I) for tag in _RAW}


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "size", "linked", "inside")

    def __init__(self, tag: str, attrs: dict[str, str], inside: bool) -> None:
        self.tag, self.attrs, self.kids, self.hash, self.size, self.linked = tag, attrs, [], 0, 0, 0
        self.inside = inside or tag in ("article", "main")


class _Stack:
    """The open elements, and where those of each tag stand, so that nothing is searched for."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: tuple[str, ...]) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def cut(self, k: int) -> None:
        while len(self.nodes) > k:
            self.places[self.nodes.pop().tag].pop()

    def close_same(self, tag: str, of: tuple[str, ...]) -> None:
        """Close the nearest open element of ``of``, if no fence of ``tag`` stands above it."""
        if (k := self.last(of)) and k > self.last(_FENCE[tag]):
            self.cut(k)


def _attributes(token: str, start: int) -> dict[str, str]:
    out: dict[str, str] = {}
    for a, v in _ATTR.findall(token, start):
        a = a.lower()
        if a in _KEPT and a not in out:
            out[a] = v[1:-1] if v[:1] in ("'", '"') else v
    return out


def parse(html: str) -> Node:
    """The tree of a page; children are nodes and strings with references decoded."""
    root = Node("html", {}, False)
    stack = _Stack(root)
    at, end = 0, len(html)
    shut: set[str] = set()  # raw elements that no end tag follows any more
    while at < end:
        m = _TOKEN.match(html, at)
        token, at = m[0], m.end()
        top = stack.nodes[-1]
        if token[0] != "<" or token == "<":
            top.kids.append(unescape(token) if "&" in token else token)
            continue
        if token[1] in "!?":
            continue
        name = _NAME.match(token)
        tag = name[1].lower()
        if token[1] == "/":
            if k := stack.last((tag,)):
                stack.cut(k)
            elif tag == "p" or tag == "br":
                top.kids.append(Node("br", {}, top.inside))
            continue
        if tag == "html":
            continue
        if tag in _CLOSES_P:
            stack.close_same("p", ("p",))
        if tag in _SAME:
            stack.close_same(tag, _SAME[tag])
        top = stack.nodes[-1]
        node = Node(tag, _attributes(token, name.end()) if len(token) > len(tag) + 3 and _WANTED.search(token, name.end()) else {}, top.inside)
        top.kids.append(node)
        if tag in _VOID or token.endswith("/>") and tag in ("svg", "path", "br", "hr", "img"):
            continue
        if tag in _RAW:
            close = None if tag in shut else _CLOSE_RAW[tag].search(html, at)
            if not close:
                shut.add(tag)
            at = close.end() if close else end
            continue
        stack.push(node)
    return root


def seal(root: Node) -> list[Node]:
    """Set the hash, text size and size of linked text of each subtree, children first; returns the nodes in that order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in node.kids if isinstance(k, Node))
    order.reverse()
    for node in order:
        h = xxhash.xxh3_64(f"{node.tag}\0{node.attrs.get('class', '')}\0{node.attrs.get('id', '')}".encode("utf-8", "surrogatepass"))
        size = linked = 0
        for k in node.kids:
            if isinstance(k, Node):
                h.update(b"\1" + k.hash.to_bytes(8, "big"))
                size += k.size
                linked += k.linked
            elif text := " ".join(k.split()):
                h.update(b"\2" + text.encode("utf-8", "surrogatepass"))
                size += len(text)
        node.hash, node.size, node.linked = h.intdigest(), size, size if node.tag == "a" else linked
    return order


def _named_furniture(node: Node) -> bool:
    """Whether a name of a container consists of words for furniture, and no name says content.

    Furniture that is links must mostly be links, or nearly empty.
    """
    a = node.attrs
    if node.tag not in _CONTAINER or not ("class" in a or "id" in a):
        return False
    names = [_PARTS.findall(x.lower()) for x in [*a.get("class", "").split(), a.get("id", "")]]
    names = [x for x in names if x]
    if any(len(x) == 1 and x[0] in _MAIN_NAMES for x in names):
        return False
    for parts in names:
        said = set(parts)
        if said <= _NAMES | _LINK_NAMES | _PLAIN:
            if said & _NAMES and not (said == {"footer"} and node.inside):
                return True
            if said & _LINK_NAMES and (2 * node.linked >= node.size or node.size <= 40):
                return True
            if said & {"header"} and not node.inside and "site" in said | {x for n in names for x in n}:
                return True
    return False


def _unwanted(node: Node) -> bool:
    if node.tag in _DROP or node.tag == "header" and not node.inside:
        return True
    a = node.attrs
    if not a or node.tag in ("html", "body", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in _DROP_ROLES or _HIDDEN.search(a.get("style", "")):
        return True
    return _named_furniture(node)


def _may_be_template(node: Node) -> bool:
    return node.size > 0 and node.tag not in ("html", "body", "article", "main") and not (node.inside and (node.tag in _TEXT_BLOCK or node.tag not in _BLOCK))


def _without_template(tree: Node, template: Callable[[Node], bool], furniture: bool) -> None:
    """Delete templates, lists that are mostly template, and, with ``furniture``, unwanted elements; sizes follow."""
    order, todo = [], [tree]
    while todo:
        node = todo.pop()
        order.append(node)
        stay, lost = [], 0
        for k in node.kids:
            if isinstance(k, Node) and (furniture and _unwanted(k) or template(k) and 2 * k.size < tree.size):
                lost += k.size
                stay.append(" ")
            else:
                stay.append(k)
        if node.tag in ("ul", "ol", "dl") and not node.inside and 2 * lost >= node.size > 0:
            stay = []
        node.kids = stay
        todo.extend(k for k in stay if isinstance(k, Node))
    for node in reversed(order):
        node.size = sum(k.size if isinstance(k, Node) else len(" ".join(k.split())) for k in node.kids)


def _roots(tree: Node) -> list[Node]:
    """Where the text stands, in page order: the outermost articles, else main, else the largest container named as content, else the page.

    A short article beside a longer one whose name says teaser or card is no part of it.
    """
    articles, mains, named = [], [], []
    todo = [tree]
    while todo:
        node = todo.pop()
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main" or node.attrs.get("role") == "main":
            mains.append(node)
        elif node.tag in ("div", "section") and node.attrs and any(set(_PARTS.findall(x.lower())) & _MAIN_NAMES for x in [*node.attrs.get("class", "").split(), node.attrs.get("id", ""), node.attrs.get("itemprop", "")]):
            named.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    full = [n for n in articles if n.size]
    if full:
        most = max(n.size for n in full)
        return [n for n in full if n.size == most or not {"teaser", "card", "preview", "summary", "related"} & set(_PARTS.findall(n.attrs.get("class", "").lower()))]
    for found in (mains, named):
        if found and (best := max(found, key=lambda n: n.size)).size:
            return [best]
    return [tree]


def main_text(tree: Node, template: frozenset[int] | set[int] | Callable[[Node], bool], *, furniture: bool = True) -> str:
    """Blocks of the article in page order, without what is in ``template`` or unwanted. The tree must be sealed; it is changed.

    Without ``furniture`` only templates are deleted, to see what counting alone does.
    """
    is_template = template if callable(template) else lambda n: n.hash in template and _may_be_template(n)
    _without_template(tree, is_template, furniture)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list[Node | str | None] = []
    for root in reversed(_roots(tree) if furniture else [tree]):
        todo += [None, root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag in ("br", "td", "th"):
            line.append(" ")
            todo.extend(reversed(x.kids))
        else:
            if x.tag in _BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return "\n".join(blocks)


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _key(at: str, h: int) -> int:
    return xxhash.xxh3_64_intdigest(at.encode("utf-8", "surrogatepass") + b"\0" + h.to_bytes(8, "big"))


def freeze(order: list[Node]) -> bytes:
    """A sealed tree, as ``seal`` orders it, as bytes: children are places in the order, or text."""
    place = {id(n): k for k, n in enumerate(order)}
    rows = [(n.tag, n.attrs, [place[id(k)] if isinstance(k, Node) else k for k in n.kids], n.hash, n.size, n.linked, n.inside) for n in order]
    return pickle.dumps(rows, 5)


def thaw(data: bytes) -> tuple[Node, list[Node]]:
    """The tree that ``freeze`` wrote, and its nodes, children first."""
    out: list[Node] = []
    for tag, attrs, kids, h, size, linked, inside in pickle.loads(data):
        n = Node(tag, attrs, inside)
        n.kids = [out[k] if isinstance(k, int) else k for k in kids]
        n.hash, n.size, n.linked = h, size, linked
        out.append(n)
    return out[-1], out


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, page, keys, tree) of each page: hashes of its host, of it and of its subtrees that may be template, and its tree."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.int64()), ("page", pa.int64()), ("keys", pa.list_(pa.int64())), ("tree", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            hosts, ids, keys, trees = [], [], [], []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                at = host(url)
                order = seal(parse(html or ""))
                own = sorted({_key(at, n.hash) for n in order if _may_be_template(n)})
                hosts.append(xxhash.xxh3_64_intdigest(at.encode("utf-8", "surrogatepass")))
                ids.append(_key(at, order[-1].hash))
                keys.append(np.array(own, np.uint64).view(np.int64))
                trees.append(freeze(order))
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), _signed(hosts), _signed(ids), pa.array(keys, pa.list_(pa.int64())), pa.array(trees, pa.binary())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, host long, page long, keys array<long>, tree binary")


def _least(pages: Column, min_share: float) -> Column:
    """On how many of a host's pages a subtree must be."""
    return F.greatest(F.lit(MIN_PAGES), F.ceil(F.least(pages / 2, F.greatest(F.lit(MANY_PAGES), pages * min_share))))


def templates(trees: DataFrame, *, min_share: float = MIN_SHARE) -> DataFrame:
    """(key) of subtrees that recur on their host, of the pages ``parsed``; equal pages count once."""
    each = trees.select("host", "page", F.explode("keys").alias("key")).distinct()
    counted = each.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    hosts = trees.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    return counted.join(hosts, "host").where(F.col("n") >= _least(F.col("pages"), min_share)).select("key")


def extract(pages: DataFrame, *, min_share: float = MIN_SHARE, furniture: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    trees = spool(parsed(pages), "html-trees")
    found = spool(templates(trees, min_share=min_share).distinct(), "html-template")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def written(batches: Iterator[pa.RecordBatch], known: Callable[[list], set[int]]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for url, tree, own in zip(b.column("url").to_pylist(), b.column("tree").to_pylist(), b.column("keys"), strict=True):
                root, _ = thaw(tree)
                at, here = host(url), known(own)
                texts.append(main_text(root, lambda n, at=at, here=here: bool(here) and _may_be_template(n) and _key(at, n.hash) in here, furniture=furniture))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    ddl = "page_id long, url string, text string, n_chars long"
    unsigned = lambda x: set(np.asarray(x, np.int64).view(np.uint64).tolist())
    if found.count() <= HELD_KEYS:
        keys = np.sort(found.toArrow()["key"].to_numpy().astype(np.int64))

        def held(own: pa.ListScalar) -> set[int]:
            mine = own.values.to_numpy() if own.is_valid and len(own.values) else np.empty(0, np.int64)
            at = np.searchsorted(keys, mine)
            return unsigned(mine[keys[np.minimum(at, len(keys) - 1)] == mine]) if len(keys) else set()

        return trees.select("page_id", "url", "keys", "tree").mapInArrow(lambda bs: written(slices(bs, 256), held), ddl)

    # too many to hold in each worker: each distinct page is joined to the templates it has
    own = trees.select("page", F.explode("keys").alias("key")).distinct().join(found, "key", "left_semi").groupBy("page").agg(F.collect_list("key").alias("keys"))
    joined = trees.select("page_id", "url", "page", "tree").join(own, "page", "left").select("page_id", "url", "keys", "tree")
    return joined.mapInArrow(lambda bs: written(slices(bs, 256), lambda own: unsigned(own.values.to_numpy()) if own.is_valid else set()), ddl)
