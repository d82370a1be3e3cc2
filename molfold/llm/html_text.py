"""Main text of web pages by composite text density.

Every block element of a page gets a density: its characters per tag, lowered
by the share of characters and tags that belong to links.  The densities of a
node's children, and that of the text it holds itself, are summed; the node
of the largest sum holds the article.  The path from it up to the body gives
the threshold: siblings along the path, of any tag, whose density is at least
the lowest density on the path belong to the article too.  A ``main`` that
holds most of the text bounds it; an ``article`` on it belongs whole, as do articles beside the
path and titles without links.

A page is one row and its work is linear in its length, so this is a narrow
map: no shuffle, and no group of pages is ever brought together.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration or a tag; quoted attributes may hold ``>``.
TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>[^"'>]+|"[^"]*"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z))""", re.S
)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold the article's own text.
APART = frozenset("head nav footer aside form button select noscript template svg canvas object audio video dialog menu map fieldset".split()) | RAW
#: An open element of the first set ends when one of the second begins.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "head": frozenset(["body"]),
}
#: Words of class, id and role that mark what surrounds an article.
AROUND = frozenset(
    "ad ads adbox adslot advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup "
    "modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus replies "
    "reply respond share sharing social related recommended newsletter subscribe subscription signup login widget pagination pager skip "
    "complementary contentinfo alert search".split()
)
#: Words that say nothing of what an element holds: ``footer-inner``, ``share-buttons`` and ``site-nav`` are marked, ``share-price`` is not.
NEUTRAL = frozenset(
    "area bar block bottom box button buttons container desktop fixed form global group holder icon icons inner item items label left link links list mobile module "
    "outer overlay page panel post posts primary right row secondary section site slot small sticky stories top unit wrap wrapper zone".split()
)
#: Words of AROUND that also head sections of articles; prose below them inside an article stays.
AMBIGUOUS = frozenset("search skip share sharing social navigation menu widget alert notice notices promotion related reply replies respond login subscription recommended".split())
#: Least share of the page's unlinked text of such a section.
SECTION = 0.02
#: Elements that are left out inside the article too if nearly all they hold is links.
LISTS = frozenset("ul ol dl div section td tr table".split())
#: Words that save an element whose name also has one of AROUND, if they end a name (``search-result-body``) or are one by themselves.
OWN = frozenset("article post entry story main content body text".split())
#: A word of AROUND after one of these tells of the layout, as in ``has-sidebar``.
WITH = frozenset("has no with without".split())
#: Words of AROUND that may name a wrapper of the whole page: one that holds most of the unlinked text stays.
LAYOUT = frozenset("sidebar menu nav navbar navigation toolbar topbar masthead search social share sharing widget skip".split())
HOLDERS = ("article", "main")


def marks(attributes: str) -> set[str]:
    """The words of class, id and role."""
    names = " ".join("".join(m) for m in NAMES.findall(attributes))
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", names)} if names else set()


def around_words(attributes: str) -> set[str]:
    """The words of AROUND that mark the element, none if a name of its own saves it."""
    found: set[str] = set()
    for names in NAMES.findall(attributes):
        for name in "".join(names).split():
            words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
            telling = [w for k, w in enumerate(words) if w in OWN or w in AROUND and not (k and words[k - 1] in WITH)]
            if telling and telling[-1] in OWN:
                return set()
            known = [w for k, w in enumerate(words) if w in AROUND or w in NEUTRAL or w in OWN or w in WITH or k and words[k - 1] in WITH]
            if len(known) == len(words):  # one other word, and the name tells of something else
                found |= AROUND.intersection(telling)
    return found


def is_around(name: str, attributes: str, inside_article: bool, held: Callable[[], tuple[int, float]] = lambda: (0, 0.0)) -> bool:
    """Whether an element is a menu, notice, advert, form, comment list or the like.

    ``held`` gives the articles and mains inside it and its share of the page's unlinked text.
    """
    if name in APART:
        return name != "form" or held()[0] == 0
    if name in ("html", "body", "article", "main"):
        return name == "article" and bool(marks(attributes) & {"comment", "comments"})
    if name == "header":
        return not inside_article
    words = marks(attributes) if attributes else None
    if not words:
        return False
    if words & {"header"} and not words & OWN and not inside_article:
        return held()[0] == 0
    around = around_words(attributes)
    if not around:
        return False
    articles, share = held()
    if inside_article and around <= AMBIGUOUS and share > SECTION:
        return False
    return not articles and not (around <= LAYOUT and share > 0.5)


def contents(page: str) -> dict[int, tuple[int, float]]:
    """By the end of its start tag, what each element holds: articles and mains, and its share of the unlinked text.

    Elements that may stay open, as paragraphs do, are left out.
    """
    out: dict[int, tuple[int, int]] = {}
    stack: list[tuple[str, int, int, int]] = []
    names: dict[str, int] = {}
    holders = chars = links = at = 0

    def close() -> None:
        name, start, before, had = stack.pop()
        names[name] -= 1
        out[start] = (holders - before, chars - had)

    while m := TAG.search(page, at):
        if not links:
            chars += len("".join(page[at : m.start()].split()))
        at, name = m.end(), (m[2] or "").lower()
        if name == "a":
            links = 0 if m[1] else 1
        if not name or name in INLINE or name in VOID or name == "p" or name in ENDS:
            continue
        if m[1]:
            links = 0
            if names.get(name):
                while stack[-1][0] != name:
                    close()
                close()
            continue
        if name in RAW:
            end = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append((name, at, holders, chars))
        names[name] = names.get(name, 0) + 1
        holders += name in HOLDERS and not is_around(name, m[3], True)
    while stack:
        close()
    return {start: (n, c / chars if chars else 0.0) for start, (n, c) in out.items()}


class Node:
    __slots__ = ("name", "parent", "children", "chars", "tags", "link_chars", "link_tags", "own", "own_tags", "density", "own_density", "total")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.children = name, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.own = self.own_tags = 0
        self.density = self.own_density = self.total = 0.0


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block elements in page order, and (owner, text) of every block of text."""
    root = Node("body", None)
    nodes, blocks = [root], []
    stack: list[tuple[str, Node]] = [("body", root)]  # block elements that are open
    pieces: list[str] = []
    linked = links = 0  # characters in links of this block; links that are open
    skipping: list[str] = []  # open elements of one that is left out
    holders = 0  # open articles and mains

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                node = stack[-1][1]
                blocks.append((node, text))
                node.own += len(text)
                node.link_chars += min(linked, len(text))
            pieces.clear()
        linked = 0

    inner: dict[int, tuple[int, float]] | None = None

    def held() -> tuple[int, float]:
        nonlocal inner
        if inner is None:  # few pages ask
            inner = contents(page)
        return inner.get(m.end(), (0, 0.0))

    at = 0
    while True:
        m = TAG.search(page, at)
        if not skipping:
            raw = page[at : m.start() if m else len(page)]
            if raw:
                pieces.append(raw)
                if links:
                    linked += len(raw)
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if skipping:
                if name in skipping:
                    while skipping.pop() != name:
                        pass
                    continue
                if name in INLINE or all(n != name for n, _ in stack[1:]):
                    continue
                skipping.clear()  # an unclosed one ends with what holds it
            if name == "a":
                links = max(0, links - 1)
            elif name == "br":
                pieces.append(" ")
            if name in INLINE:
                continue
            flush()
            links = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    holders -= sum(n in HOLDERS for n, _ in stack[k:])
                    del stack[k:]
                    break
            continue
        if name in RAW:
            end = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if not skipping and name not in ("script", "style"):
                flush()
            continue
        if skipping:
            while skipping and (name in ENDS.get(skipping[-1], ()) or skipping[-1] == "p" and name not in INLINE):
                skipping.pop()
            if skipping:
                if name not in VOID and not m[3].endswith("/"):
                    skipping.append(name)
                continue
        node = stack[-1][1]
        node.own_tags += 1
        if name in INLINE:
            if name == "a":
                links += 1
                node.link_tags += 1
            elif name == "br":
                pieces.append(" ")
            if name in VOID or not m[3] or not is_around(name, m[3], holders > 0, held):
                continue
        if name not in INLINE:
            flush()
            links = 0
        if name in VOID or name in ("html", "body"):
            continue
        if stack[-1][0] == "p" and name not in INLINE:
            stack.pop()
        while name in ENDS.get(stack[-1][0], ()):
            stack.pop()
        if is_around(name, m[3], holders > 0, held):
            if not m[3].endswith("/") or name not in ("svg", "object"):
                skipping.append(name)
            continue
        node = Node(name, stack[-1][1])
        node.parent.children.append(node)
        nodes.append(node)
        stack.append((name, node))
        holders += name in HOLDERS
    flush()
    return nodes, blocks


def weigh(nodes: list[Node]) -> None:
    """Sums over subtrees, then density and density sum of every node."""
    for node in reversed(nodes):
        node.chars += node.own
        node.tags += node.own_tags
        if node.parent is not None:
            p = node.parent
            p.chars += node.chars
            p.tags += node.tags
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0

    def density(chars: int, tags: int, link_chars: int, link_tags: int) -> float:
        if not chars:
            return 0.0
        base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e**math.e)
        ratio = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
        return chars / max(tags, 1) * max(0.0, math.log(ratio)) / math.log(base)

    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags)
    for node in nodes:
        own_links = node.link_chars - sum(c.link_chars for c in node.children)
        node.own_density = density(node.own, node.own_tags - len(node.children), own_links, 0)
        node.total = sum(c.density for c in node.children) + node.own_density


def is_link_list(node: Node) -> bool:
    """Whether an element holds several links and little else."""
    return node.name in LISTS and node.link_tags > 1 and node.link_chars * 5 >= node.chars * 4


def main_text(page: str | None) -> str:
    """The article's blocks joined by empty lines; empty for null and for pages without text."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    weigh(nodes)
    bare = lambda n: n.chars - n.link_chars
    scope = max((n for n in nodes if n.name == "main"), key=bare, default=None)
    if scope is None or bare(scope) * 2 <= bare(nodes[0]):
        scope = nodes[0]  # a main of little text is no evidence
    within = {id(scope)}
    for node in nodes:  # parents come first
        if node.parent is not None and id(node.parent) in within:
            within.add(id(node))
    best = max((n for n in nodes if id(n) in within), key=lambda n: n.total)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    chosen = {id(best)}
    article = next((n for n in path if n.name == "article"), None)
    if article is not None:
        chosen.add(id(article))
    limit = min(n.density for n in path)
    top = path.index(next((n for n in path if n.name == "main"), path[-1]))
    dense = lambda n: n.density >= limit and n.link_chars * 3 < n.chars
    own = set()  # nodes on the path whose own text is dense, not all they hold
    for node in path[1 : top + 1]:
        chosen.update(id(c) for c in node.children if c not in path and c.chars and (dense(c) or c.name in HOLDERS and c.link_chars * 3 < c.chars or c.name == "h1" and c.link_chars == 0))
        if node.own and node.own_density >= limit:
            own.add(id(node))
    inside: dict[int, bool] = {}
    for node in nodes:  # parents come first
        inside[id(node)] = not is_link_list(node) and (id(node) in chosen or (node.parent is not None and inside[id(node.parent)]))
    return "\n\n".join(text for node, text in blocks if inside[id(node)] or id(node) in own)


def page_text(page: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(p.as_py()) for p in batch], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()(page)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page, repeated rows included.

    A null or empty page, and one without text, has an empty text.
    """
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), page_text(F.col(html_col)).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
