"""Main text of web pages by composite text density.

The page becomes a tree; the work for it grows with the page, however deep it is nested.
Elements that never hold the article (scripts, menus, page headers and footers, sidebars,
notices, adverts, reader comments) are cut off; they end as any element does, where their
end tag or what implies it stands. A form is cut off unless it is the page's frame: it holds
an article, a main part, a page header, footer or menu, or all of the page's paragraphs. A part
that only its class or id calls no article is cut off where an ``article`` or ``main`` element
outside of all such parts has text; on other pages unless hardly any text of the page stands
elsewhere: then the name is no sign, and the largest such part is kept.
Every node gets its composite density: characters per tag, scaled by a logarithm that
falls as more of the characters stand in links. A node's density sum is that of its
children. The node with the largest density sum is the core; the least density on its
path to the body is the threshold, and of every node that reaches it the subtree with
the largest density sum is content; where that is a lone paragraph or a part of an
``article`` element, what holds it is. A ``main`` element whose text outside of its one article
is mostly links is that article.

Defined results: null and empty pages give an empty text; a page without a body is
taken as a body; a cut-off page is read as far as it goes; of equal density sums the
outermost and first counts; repeated rows and ids give rows each; an empty table gives no
rows; columns besides id, url and html are not read; nothing is shortened.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end, blocks, elements that a new one ends, and what is no article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_PARAGRAPH = BLOCKS - set("body html td th tr tbody thead tfoot caption li dd dt summary figcaption".split()) | {"li", "dd", "dt"}
ENDS_LIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NEVER = set("script style noscript template iframe object svg canvas math head title nav aside button select textarea input dialog audio video footer menu".split())
NEVER_ROLES = set("navigation banner contentinfo search complementary dialog alert menu menubar toolbar form".split())
#: Whole class names and ids of what is no article, and words that are such by their beginning.
NEVER_WORDS = set(
    "ad ads adsense banner cookie cookies consent gdpr notice alert sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "comment comments commentlist respond disqus replies share sharing social related newsletter subscribe signup login popup modal overlay footer masthead site-header page-header toolbar skip widget".split()
)
NEVER_STARTS = ("advert", "sponsor", "promo", "recommend")
#: Of these names those that are never taken for the article's own, however long what they hold is.
READERS = set("comment comments commentlist respond disqus replies".split())
#: Share of a page's text that must stand outside of all parts cut off by their names.
ELSEWHERE = 0.1
#: With these a compound name is still one of an unwanted part; with others (no-sidebar, with-comments) it is a mark on what may hold the article.
NEUTRAL = set("site page box block slot unit area bar link links list item items button buttons icons section inner form posts wrap wrapper container".split())
HEAD = set("title meta link base script style noscript template head".split())
CONTAINERS = set("article main section div body html td center".split())
HOLDS_ARTICLE = {"article", "main", "body", "html"}
#: What makes a form that holds it the frame of its page.
FRAME = {"article", "main", "header", "footer", "nav"}
FOREIGN, SCOPES = {"svg", "math"}, {"table", "object", "template", "svg", "math"}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "chars", "cut", "suspect", "density", "density_sum", "link_chars", "links", "parent", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False) -> None:
        self.tag, self.parent, self.children, self.cut = tag, parent, [], cut
        self.chars = self.link_chars = self.tags = self.links = 0
        self.density = self.density_sum = 0.0
        self.suspect = False


def _unwanted(value: str) -> str:
    """What one of the class names or ids calls the part: 'readers', 'other' or nothing of what holds no article."""
    found = ""
    is_word = lambda w: w in NEVER_WORDS or w.startswith(NEVER_STARTS)
    for token in value.lower().split():
        parts = re.split(r"[_-]+", token)
        if token in NEVER_WORDS or any(map(is_word, parts)) and all(is_word(w) or w in NEUTRAL for w in parts):
            if READERS.intersection([token, *parts]):
                return "readers"
            found = "other"
    return found


class _Tree(HTMLParser):
    """Open elements are a stack, and the places of each tag in it a list, so that no ancestors are walked."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None)
        self.stack, self.places = [self.root], defaultdict(list)
        self.suspects, self.forms, self.framed = False, [], set()

    @property
    def at(self) -> Node:
        return self.stack[-1]

    def _nearest(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _leave(self, place: int) -> None:
        """End the open element at a place of the stack, and all in it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def _close(self, tags: set[str], within: set[str] = frozenset()) -> None:
        """End the nearest open element of ``tags``, unless one of ``within`` is nearer."""
        place = self._nearest(tags)
        if place > self._nearest(within):
            self._leave(place)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self._close({"head"})
        elif self.at.tag == "head" and tag not in HEAD:
            self._leave(len(self.stack) - 1)
        if tag in BLOCKS:
            self._close(FOREIGN, {"foreignobject", "desc", "annotation-xml"})
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"td", "th", "button", "table", "article", "section", "div", "blockquote"})
        if tag in ENDS_LIKE:
            self._close(*ENDS_LIKE[tag])
        node = Node(tag, self.at, self.at.cut or self._never(tag, attrs))
        if not node.cut and tag not in HOLDS_ARTICLE and any(_unwanted(v) == "other" for n, v in attrs if v and n in ("class", "id")):
            node.suspect = self.suspects = True
        if tag == "form" and not node.cut:
            self.forms.append(node)
        if tag in FRAME and self.places["form"]:
            self.framed.add(id(self.stack[self.places["form"][0]]))
        self.at.children.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self._nearest(FOREIGN) and self.at.tag == tag:
            self._leave(len(self.stack) - 1)

    def _never(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER:
            return True
        inside = bool(self.places["article"] or self.places["main"])
        if tag == "header" and not inside or tag == "label" and not self.places["article"]:
            return True
        if tag in HOLDS_ARTICLE:
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if value and (name == "role" and value.lower() in NEVER_ROLES or name in ("class", "id") and _unwanted(value) == "readers"):
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            if not self.at.cut:
                self.at.children.append(" ")
        elif tag not in VOID:
            self._close({tag}, SCOPES - {tag} if tag not in HOLDS_ARTICLE else frozenset())

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and data.strip():
            self._leave(len(self.stack) - 1)
        if not self.at.cut:
            self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    if tree.forms:
        _cut_forms(tree)
    if tree.suspects:
        _judge(tree.root)
    for node in _in_order(tree.root):
        node.children = [("\n" if c.tag in BLOCKS else " ") if isinstance(c, Node) and c.cut else c for c in node.children]
    return tree.root


def _characters(nodes: list[Node], of=lambda node: True) -> dict[int, int]:
    """Characters outside of links and cut parts in each node's subtree, where they are directly in nodes ``of`` or below such."""
    chars: dict[int, int] = {}
    for node in reversed(nodes):
        chars[id(node)] = 0 if node.cut or node.tag == "a" else sum((len(c.strip()) if of(node) else 0) if isinstance(c, str) else chars[id(c)] for c in node.children)
    return chars


def _cut_forms(tree: _Tree) -> None:
    """Cut the forms off that are not the frame of their page."""
    nodes = _in_order(tree.root)
    inside: set[int] = set()
    for node in nodes:  # parents first
        if node.tag == "p" or node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
    chars = _characters(nodes, lambda node: id(node) in inside)
    for form in tree.forms:
        whole = chars[id(form)] > 0 and chars[id(form)] == chars[id(tree.root)]
        form.cut = not (id(form) in tree.framed or whole)


def _judge(root: Node) -> None:
    """Cut the parts off that their names call no article, but for the one without which hardly any text is left on a page without an article."""
    nodes = _in_order(root)
    chars, named, marked = _characters(nodes), set(), False
    for node in nodes:
        if node.suspect or node.cut or node.parent is not None and id(node.parent) in named:
            named.add(id(node))
        elif node.tag in ("article", "main"):
            marked |= _outside(node) > 0
    while True:
        outer, waiting = [], [root]
        while waiting:
            node = waiting.pop()
            if node.suspect:
                outer.append(node)
            elif not node.cut:
                waiting.extend(c for c in node.children if isinstance(c, Node))
        total, held = chars[id(root)], sum(chars[id(n)] for n in outer)
        spared = max(outer, key=lambda n: chars[id(n)]) if held and not marked and total - held < ELSEWHERE * total else None
        for node in outer:
            node.suspect = False
            node.cut = node is not spared
        if spared is None:
            return


def _outside(root: Node) -> int:
    """Characters of a subtree outside of links and of parts that are cut or named."""
    total, waiting = 0, [root]
    while waiting:
        for child in waiting.pop().children:
            if isinstance(child, str):
                total += len(child.strip())
            elif not (child.cut or child.suspect or child.tag == "a"):
                waiting.append(child)
    return total


def _in_order(root: Node) -> list[Node]:
    """All nodes, every parent before its children."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        found.append(node)
        waiting.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def measure(root: Node) -> list[Node]:
    """Set every node's counts, composite density and density sum; the nodes, parents first."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(_SPACE.sub(" ", child).strip())
            else:
                node.chars += child.chars
                node.link_chars += child.link_chars
                node.tags += child.tags + 1
                node.links += child.links + (child.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        chars, links = node.chars, node.link_chars
        if not chars:
            continue
        base = math.log(chars / max(chars - links, 1) * links + ratio * chars + math.e)
        value = (chars / max(links, 1)) * (max(node.tags, 1) / max(node.links, 1))
        node.density = chars / max(node.tags, 1) * math.log(max(value, 1.0)) / math.log(max(base, 1.0 + 1e-9))
    for node in nodes:
        node.density_sum = sum(c.density for c in node.children if isinstance(c, Node))
    return nodes


def _containers(nodes: list[Node]) -> dict[int, Node]:
    """Of each node the article that it is in, or else what holds it: a paragraph is no whole article, nor is a heading."""
    article: dict[int, Node | None] = {}
    near: dict[int, Node] = {}
    for node in nodes:  # parents first
        up = node.parent
        article[id(node)] = node if node.tag in ("article", "main") else article[id(up)] if up is not None else None
        near[id(node)] = node if up is None or node.tag in CONTAINERS else near[id(up)]
    mains = {id(n): _one_article(n) for n in nodes if n.tag == "main"}
    return {i: mains.get(id(above), above) if above is not None else near[i] for i, above in article.items()}


def _one_article(main: Node) -> Node:
    """The only article of a main part that has besides it mostly links (teasers); else the part."""
    articles, waiting = [], [main]
    while waiting and len(articles) < 2:
        for child in waiting.pop().children:
            if isinstance(child, Node) and not child.cut:
                (articles if child.tag == "article" and child.chars else waiting).append(child)
    if len(articles) == 1:
        one = articles[0]
        chars, links = main.chars - one.chars, main.link_chars - one.link_chars
        if chars and 2 * links >= chars:
            return one
    return main


def content_nodes(root: Node) -> list[Node]:
    """The subtrees that are content, in page order; none within another."""
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    core = max(nodes, key=lambda n: n.density_sum)  # of equals the first, so the outermost
    if not core.density_sum:
        return [body]
    threshold, node = core.density, core
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    best: dict[int, Node] = {}
    for node in reversed(nodes):
        top = node
        for child in node.children:
            if isinstance(child, Node) and best[id(child)].density_sum > top.density_sum:
                top = best[id(child)]
        best[id(node)] = top
    holds = _containers(nodes)
    chosen = {id(holds[id(best[id(n)])]) for n in nodes if n.density >= threshold and n.density > 0}
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if id(node) in chosen:
            found.append(node)
        else:
            waiting.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def _pieces(node: Node) -> Iterator[str | None]:
    """Text of the subtree in order; None where a block begins or ends."""
    waiting: list[Node | str | None] = [node]
    while waiting:
        item = waiting.pop()
        if item is None or isinstance(item, str):
            yield item
            continue
        edge = [None] if item.tag in BLOCKS else [" "] if item.tag == "br" else []
        waiting += edge + list(reversed(item.children)) + edge


def text_blocks(nodes: list[Node]) -> list[str]:
    found, held = [], []
    for node in nodes:
        for piece in (None, *_pieces(node), None):
            if piece is not None:
                held.append(piece)
            elif held:
                block = _SPACE.sub(" ", "".join(held)).strip()
                held = []
                if block:
                    found.append(block)
    return found


def main_text(html: str | None) -> str:
    return "\n\n".join(text_blocks(content_nodes(parse(html)))) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
