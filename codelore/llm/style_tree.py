"""Main text of pages by a site style tree.

The pages of a host are merged: an element of the tree stands for all elements that are reached by the same
tags, classes and sequences of children; it counts the sequences of its own children (its styles) and the texts,
links and images right inside it.  An element whose styles or contents vary between pages is important,
one that repeats is not: its importance is the entropy of its styles, or one less the mean entropy of its contents over
the pages, in units of the logarithm of its number of pages.  A branch's importance mixes its root's with that of
its children with text and of its own text.  A branch is cut from a page if neither it nor any text in it reaches the
threshold, inside articles too; inline elements amid running text stay or go with it.  Markup is a prior: navigation,
adverts, forms, comments and the like have no importance; an article counts as one more page on which its elements
vary and is never cut down to its headings; beside an article a branch needs a higher importance, and more text outside
links than inside.

A branch is judged along the page's own styles, so that no host has to be gathered: counts are summed by
element over all pages, copies of a page on a host as one, and each page looks up its own elements.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import salted_lookup

#: Least importance of a branch that stays, the same beside an article, and the weight of children by depth.
THRESHOLD, BESIDE, GAMMA = 0.2, 0.5, 0.9
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85   -     　]+")
_PARTS = re.compile(r"[a-z0-9]+")

# Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes svg math canvas object audio video select option textarea button input label datalist dialog map".split())
CHROME = frozenset("nav footer aside form menu fieldset".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An open element of the value's kinds ends where the key begins, inside the nearest of the given scopes.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Words of classes, ids and roles that name what isn't the article.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead header comments comment commentlist disqus replies reply respond cookie cookies notice notices consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager toolbar search tags skip contentinfo complementary".split()
)
#: Those of them that name readers' remarks, and words that only say which part of a branch a name means.
REMARK_WORDS = frozenset("comments comment commentlist disqus replies reply respond".split())
PART_WORDS = frozenset(
    "left right top bottom upper lower middle center first last primary secondary main global site page mobile desktop small large fixed sticky list lists item items area areas box boxes block blocks bar bars container wrapper wrap inner outer section row col column content body text title heading head label link links button buttons btn icon icons form field input post posts article articles story stories unit slot panel group set toggle tree thread author meta count image img".split()
)


class Node:
    __slots__ = ("article", "children", "chrome", "doubtful", "holds", "inside", "key", "links", "mark", "named", "parent", "remark", "tag")

    def __init__(self, tag: str, mark: str, parent: Node | None):
        self.tag, self.mark, self.parent = tag, mark, parent
        self.children: list[Node | str] = []
        self.links: list[str] = []
        self.chrome = self.article = self.holds = self.inside = self.named = self.doubtful = self.remark = False
        self.key = 0


@functools.lru_cache(4096)
def _names(mark: str) -> tuple[bool, bool, bool]:
    """Whether classes and ids name chrome for certain, only perhaps, and readers' remarks.

    A word counts as a whole class or as its leading part; it is certain if the rest only says which part is meant.
    """
    certain = perhaps = remark = False
    for name in mark.split():
        parts = _PARTS.findall(name)
        if parts and (first := parts[0].rstrip("0123456789")) in CHROME_WORDS:
            if all(x in CHROME_WORDS or x in PART_WORDS or x.isdigit() or len(x) < 3 for x in parts[1:]):
                certain, remark = True, remark or first in REMARK_WORDS
            else:
                perhaps = True
    return certain, perhaps and not certain, remark


def parsed(html: str) -> Node:
    """The tree of a page; unclosed and stray tags are taken as browsers mostly take them."""
    root = here = Node("#page", "", None)
    at, end = 0, len(html)
    while at < end:
        found = _TAG.search(html, at)
        if found is None:
            here.children.append(html[at:])
            break
        if found.start() > at:
            here.children.append(html[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            up = here
            while up is not None and up.tag != name:
                up = up.parent
            if up is not None and up.parent is not None and name not in ("html", "body"):
                # An inline end tag doesn't end the blocks opened since.
                inner = here
                while name not in BLOCK and inner is not up and inner.tag not in BLOCK:
                    inner = inner.parent
                if name in BLOCK or inner is up:
                    here = up.parent
            continue
        if name in ("html", "body") and here.tag != "#page":
            up = here
            while up is not None and up.tag != name:
                up = up.parent
            if up is not None:
                continue
        if name == "body":
            up = here
            while up.parent is not None and up.tag != "html":
                up = up.parent
            here = up
        if name in ENDS_P:
            up = here
            while up.parent is not None and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p" or (up.tag in _HEADINGS and name in _HEADINGS):
                here = up.parent
        if name in CLOSES:
            kinds, scopes = CLOSES[name]
            up = last = here
            while up.parent is not None and up.tag not in scopes:
                if up.tag in kinds:
                    last = up.parent
                up = up.parent
            here = last
        attributes = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(found[3])} if found[3].strip(" /") else {}
        node = Node(name, " ".join(attributes.get(a, "") for a in ("class", "id")).strip().lower() if attributes else "", here)
        if attributes:
            if link := attributes.get("href") or attributes.get("src"):
                here.links.append(link)
            node.named, node.doubtful, node.remark = _names(f"{node.mark} {attributes.get('role', '').lower()}")
            node.chrome = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            node.article = attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody"
        if name in UNSEEN or name in CHROME:
            node.chrome = True
        elif name in ("html", "body"):
            node.chrome = node.named = node.doubtful = node.remark = False
        elif name in ("article", "main"):
            node.article = not node.chrome
        elif name == "header":
            up = here
            while up is not None and up.tag not in ("article", "main"):
                up = up.parent
            node.chrome |= up is None
            # The head of an article holds its title.
            node.doubtful, node.named = node.doubtful or node.named, False
        if node.article and not node.remark:
            node.named = node.doubtful = False  # never by name alone
        here.children.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            at = end if close is None else (html.find(">", close.start()) + 1 or end)
        elif name not in VOID:
            here = node
    return root


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _hash(*parts: object) -> int:
    """A signed 64-bit hash that every executor computes alike."""
    return xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace")) - (1 << 63)


def name_nodes(root: Node, host: str, with_contents: bool = True) -> list[tuple[Node, int, list[int]]]:
    """Give every element outside chrome its key in the style tree; the element, its style and its contents, parents first.

    Contents are the links, then the texts.
    """
    out = []
    root.key = _hash(host, "#page")
    todo = [root]
    while todo:
        node = todo.pop()
        runs: list[str] = []
        members: list[tuple[Node, int]] = []
        contents = [_hash("link", x) for x in node.links] if with_contents else []
        for child in node.children:
            if isinstance(child, str):
                if with_contents and (text := " ".join(child.split())):
                    contents.append(_hash("text", text))
                continue
            kind = f"{child.tag}.{child.mark}"
            if not runs or runs[-1] != kind:  # a run of alike children is one element of the style
                runs.append(kind)
            members.append((child, len(runs)))
        style = _hash(node.key, *runs)
        place, key = 0, 0
        for child, at in members:
            if at != place:
                place, key = at, _hash(style, at)
            child.key = key
        out.append((node, style, contents))
        todo += [c for c, _ in reversed(members) if not c.chrome]
    return out


def _has_text(root: Node) -> bool:
    """Whether the page has text outside chrome."""
    todo: list[Node | str] = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if item.strip():
                return True
        elif not item.chrome:
            todo += item.children
    return False


def _mark_articles(root: Node) -> bool:
    """Mark what is chrome by its name, and the containers of the page's articles; whether it has any.

    Articles inside chrome count only if there is none outside; then containers that are chrome by their
    names alone are freed.  Readers' remarks are no articles, unless a single one outside a block of remarks is all the page has.
    """
    clear: list[Node] = []
    hidden: list[Node] = []
    remarks: list[Node] = []
    todo = [(root, 0)]
    while todo:
        node, under = todo.pop()
        if node.article and node.remark and not under:
            remarks.append(node)
        under = max(under, 2 if node.tag in UNSEEN or node.tag in ("nav", "footer", "aside") or node.remark else int(node.chrome or node.named))
        if node.article and under < 2:
            (hidden if under else clear).append(node)
        node.chrome = node.chrome or node.named
        todo += [(c, under) for c in node.children if not isinstance(c, str)]
    chosen = clear or hidden
    if not chosen and len(remarks) == 1 and not _has_text(root):
        chosen = remarks
    for node in chosen:
        while node is not None and not node.holds:
            node.holds, node.chrome = True, False
            node = node.parent
    todo = [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if not isinstance(c, str) and not c.chrome:
                c.inside = node.inside or (c.article and c.holds)
                todo.append(c)
    return bool(chosen)


def main_text(html: str, host: str, importance: dict[int, tuple[float, float]]) -> str:
    """The page's text without branches of low importance.

    ``importance`` has the importance of elements and the pages it was taken from; elements not given have importance 1.
    """
    root = parsed(html)
    articles = _mark_articles(root)
    order = [node for node, _, _ in name_nodes(root, host, False)]
    branch: dict[int, float] = {}
    peak: dict[int, float] = {}
    size: dict[int, tuple[int, int]] = {}
    running: dict[int, bool] = {}
    cut: set[int] = set()
    for node in reversed(order):
        own, pages = importance.get(node.key, (1.0, 0.0))
        if node.inside:
            own = (own * pages + 1) / (pages + 1)
        me = id(node)
        direct = text = sum(len(x.strip()) for x in node.children if isinstance(x, str))
        linked = 0
        inner = [c for c in node.children if not isinstance(c, str) and not c.chrome]
        for c in inner:
            more = size[id(c)]
            text, linked = text + more[0], linked + more[1]
        size[me] = text, text if node.tag == "a" else linked
        # Line breaks, images and the like have nothing to judge; text right inside an element is a leaf of its own.
        inner = [c for c in inner if size[id(c)][0]]
        leaves = [branch[id(c)] for c in inner] + ([own] if direct else [])
        share = GAMMA ** len(leaves)
        branch[me] = (1 - share) * own + share * sum(leaves) / len(leaves) if inner else own
        peak[me] = max(branch[me], *leaves, *(peak[id(c)] for c in inner)) if text else 0.0
        beside = articles and not node.inside
        if node.holds or node.tag in ("#page", "html", "body"):
            # Text right inside what holds the article is beside it.
            if beside and own < BESIDE:
                node.children = [c for c in node.children if not isinstance(c, str)]
            if not node.article:
                continue
        if node.tag not in BLOCK:
            up = id(node.parent)
            if up not in running:
                running[up] = any(isinstance(x, str) and x.strip() for x in node.parent.children)
            if running[up]:
                continue  # amid running text, with which it stays or goes
        # So does a name that may mean chrome.
        if peak[me] < (BESIDE if beside or node.doubtful else THRESHOLD) or (beside and 2 * size[me][1] > text):
            cut.add(me)
    if articles and cut and not _article_left(root, cut):
        cut -= {id(node) for node in order if node.inside or node.article}
    return _read(root, cut)


def _article_left(root: Node, cut: set[int]) -> bool:
    """Whether the page's articles keep any text but headings; an article that repeats as a whole is no boilerplate."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.chrome or id(node) in cut or node.tag in _HEADINGS:
            continue
        if (node.inside or node.article) and any(isinstance(x, str) and x.strip() for x in node.children):
            return True
        todo += [c for c in node.children if not isinstance(c, str)]
    return False


def _read(root: Node, cut: set[int]) -> str:
    pieces: list[str] = []
    stack: list[Node | str | None] = [root]
    while stack:
        item = stack.pop()
        if item is None:
            pieces.append(" ")
            continue
        if isinstance(item, str):
            pieces.append(unescape(item))
            continue
        spaced = item.tag in BLOCK or item.tag == "br"
        if spaced:
            pieces.append(" ")
        if item.chrome or id(item) in cut:
            continue
        if spaced:
            stack.append(None)
        stack += reversed(item.children)
    return _SPACE.sub(" ", "".join(pieces)).strip(" ")


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#\s]+)", url or "")
    return found[1].rpartition("@")[2].lower() if found else ""


def _payload(host: str, html: str, named: list[tuple[Node, int, list[int]]]) -> int:
    """What copies of a page have alike: the host and the texts of its articles, or all texts if most are beside them."""
    inside: list[int] = []
    every: list[int] = []
    long = short = 0
    for node, _, contents in named:
        texts = contents[len(node.links) :]
        every += texts
        size = sum(len(x) for x in node.children if isinstance(x, str))
        if node.inside:
            inside += texts
            long += size
        else:
            short += size
    return _hash("payload", host, *(inside if inside and long >= short else every or [html]))


def style_counts(pages: DataFrame, once: bool = False) -> DataFrame:
    """Importance of every element of every host's style tree that isn't fully important: ``key, importance, pages``.

    ``once``: copies of a page on a host count as one page, for what repeats only in copies is no boilerplate.
    """

    def run(batches):
        for batch in batches:
            found: dict[int, list[tuple[int, int, int, int]]] = {}
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                if html and (host := host_of(url)):
                    root = parsed(html)
                    _mark_articles(root)
                    named = name_nodes(root, host)
                    page: Counter = Counter()
                    for node, style, contents in named:
                        page[node.key, 0, style] = 1  # a run of alike elements is one
                        for x in contents:
                            page[node.key, 1, x] += 1
                    rows = sorted((*k, n) for k, n in page.items())
                    payload = _payload(host, html, named) if once else len(found)
                    found[payload] = min(rows, found.get(payload, rows))  # no matter which copy comes first
            flat = [r for rows in found.values() for r in rows]
            kinds = {"key": pa.int64(), "kind": pa.int32(), "what": pa.int64(), "n": pa.int64()}
            counts = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate(kinds.values())], list(kinds))
            ends = [0, *itertools.accumulate(map(len, found.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counts)], names=["payload", "counts"])

    rows = pages.select("url", "html").mapInArrow(run, "payload long, counts array<struct<key: long, kind: int, what: long, n: long>>")
    if once:
        rows = rows.groupBy("payload").agg(F.min("counts").alias("counts"))
    rows = rows.select(F.explode("counts").alias("c")).select("c.*")
    each = rows.groupBy("key", "kind", "what").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"))
    style, content = F.col("kind") == 0, F.col("kind") == 1
    entropy = F.log("n") - F.col("n_log_n") / F.col("n")
    node = each.groupBy("key").agg(
        F.sum(F.when(style, F.col("n"))).alias("pages"),
        F.sum(F.when(style, F.col("n") * F.log("n"))).alias("styles"),
        F.avg(F.when(content, entropy)).alias("contents"),
    )
    size = F.log("pages")
    by_style = (size - F.col("styles") / F.col("pages")) / size
    found = F.when(F.col("contents").isNotNull(), 1 - F.least(F.lit(1.0), F.col("contents") / size)).otherwise(by_style)
    return node.where(F.col("pages") > 1).select("key", F.round(found, 9).alias("importance"), F.col("pages").cast("double").alias("pages")).where(F.col("importance") < 1)


def extract(pages: DataFrame) -> DataFrame:
    """Add ``text`` to pages(page_id, url, html).

    A null or empty page has the empty text.  Pages without a host are judged by their markup alone.
    Rows of one page_id share the elements looked up for it, so that repeated rows give equal texts.
    """
    keys = "array<long>"

    def named(batches):
        for batch in batches:
            out = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host = host_of(url)
                keys: set[int] = set()
                if html and host:
                    root = parsed(html)
                    _mark_articles(root)
                    keys = {n.key for n, _, _ in name_nodes(root, host, False)}
                out.append(sorted(keys))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.list_(pa.int64()))], names=["page_id", "keys"])

    elements = pages.select("page_id", "url", "html").where(F.col("page_id").isNotNull()).mapInArrow(named, f"page_id long, keys {keys}").select("page_id", F.explode("keys").alias("key"))
    found = salted_lookup(elements, style_counts(pages, once=True), "key", F.col("page_id")).where(F.col("importance").isNotNull())
    page = found.groupBy("page_id").agg(F.collect_set(F.struct("key", "importance", "pages")).alias("_found"))
    joined = pages.join(page, "page_id", "left")
    keep = [c for c in joined.columns if c not in ("text", "_found", "html")]

    def run(batches):
        for batch in batches:
            texts = []
            for url, html, found in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), batch.column("_found").to_pylist()):
                texts.append(main_text(html, host_of(url), {x["key"]: (x["importance"], x["pages"]) for x in found or ()}) if html else "")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keep).schema.fields)
    return joined.mapInArrow(run, f"{schema}, text string")
