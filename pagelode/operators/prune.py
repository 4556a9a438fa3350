"""A page's content without its boilerplate, by a block tree scored by the density of its text and links.

Every block (paragraph, item, cell and so on) weighs what it has of text outside links, and gives that to the elements around it, the
less the farther they are. The element of the greatest weight, less its share of links, holds the content; neighbours with a fifth of
its weight belong to it. In it, blocks that are mostly links go, as do elements whose tag or names say what they are (menus, forms, footers,
adverts, comments of readers). What stays is given as text and as Markdown. Works in Arrow batches, on one page at a time.

Defined cases: a null page, an empty one, or one without a block that weighs anything has no content (null); a page that is one text has that;
headings inside the content stay whatever their length; a page all of whose text is inside named boilerplate has no content."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.markup import SPACE, Elements
from pagelode.functions.shipping import ship_package

CONTENT = "struct<text:string,markdown:string,share:double>"

BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
BOXES = frozenset("article body div html main section td".split())
HEADINGS = {f"h{n}": "#" * n for n in range(1, 7)}
#: Elements that hold no content, and names (classes, ids, roles) of such ones, unless a name of the second kind is there, too.
DROPPED = frozenset("nav footer aside form button select textarea noscript iframe svg head title dialog".split())
UNWANTED = re.compile(r"(?i)(^|[-_\s])(ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|masthead|menu|modal|nav\w*|newsletter|pagination|popup|promo\w*|related|repl(?:y|ies)|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)($|[-_\s])")
WANTED = re.compile(r"(?i)(^|[-_\s])(article|body|content|entry|job|main|post|story|vacancy)($|[-_\s])")
#: Levels above a block that have a share of its weight; the share of links from which on a block goes; a neighbour's least weight.
LEVELS, LINKED, NEIGHBOUR = 4, 0.5, 0.2


def _shown(text: str) -> int:
    return sum(map(len, text.split()))


class _Tree:
    """Of each element whether it's left out, its block, and the characters of its subtree, all and in links."""

    def __init__(self, page: str) -> None:
        self.e = e = Elements(page)
        n = len(e.tags)
        self.out, self.linked, self.block = [False] * n, [False] * n, [0] * n
        for x in range(1, n):
            up, tag = e.parents[x], e.tags[x]
            names = " ".join(e.attributes[x].get(k, "") for k in ("class", "id", "role"))
            mine = tag in DROPPED or (tag == "header" and not self._within(x, ("article", "main"))) or bool(UNWANTED.search(names) and not WANTED.search(names))
            self.out[x] = self.out[up] or mine
            self.linked[x] = self.linked[up] or tag == "a"
            self.block[x] = x if tag in BLOCKS else self.block[up]
        self.text = [entities.unescape(t) for t in e.texts]
        sizes = [_shown(t) for t in self.text]
        self.all = sum(sizes)
        self.sums, self.links = [0], [0]
        self.own, self.own_links = [0] * n, [0] * n
        for owner, size in zip(e.owners, sizes, strict=True):
            if self.out[owner]:
                size = 0
            self.sums.append(self.sums[-1] + size)
            self.links.append(self.links[-1] + size * self.linked[owner])
            self.own[self.block[owner]] += size
            self.own_links[self.block[owner]] += size * self.linked[owner]

    def _within(self, x: int, tags: tuple[str, ...]) -> bool:
        while x:
            x = self.e.parents[x]
            if self.e.tags[x] in tags:
                return True
        return False

    def weights(self) -> dict[int, float]:
        """What each element has of the weight of the blocks below it."""
        found: dict[int, float] = {}
        for b in range(len(self.own)):
            free = self.own[b] - self.own_links[b]
            if free <= 0 or self.e.tags[b] in HEADINGS:
                continue
            # A paragraph stands in what holds the content; a box of text of its own may be that.
            x = b if self.e.tags[b] in BOXES or not b else self.block[self.e.parents[b]]
            for level in range(1, LEVELS + 1):
                found[x] = found.get(x, 0.0) + free / level
                if not x:
                    break
                x = self.block[self.e.parents[x]]
        out = {}
        for x, w in found.items():
            low, high = self.e.pieces(x) if x else (0, len(self.text))
            size = self.sums[high] - self.sums[low]
            out[x] = w * (1 - (self.links[high] - self.links[low]) / size) if size else 0.0
        return out

    def content(self) -> list[int]:
        """The elements that hold the content, in page order."""
        weights = self.weights()
        if not weights or max(weights.values()) <= 0:
            return []
        top = min(weights, key=lambda x: (-weights[x], x))
        # A block that holds the content alone stands for its parent: the blocks beside it have their say.
        around = self.block[self.e.parents[top]] if top else 0
        beside = [x for x, w in weights.items() if x and x != top and self.block[self.e.parents[x]] == around and w >= NEIGHBOUR * weights[top]]
        return sorted({top, *beside})


def content_of(page: str | None) -> tuple[str | None, str | None, float | None]:
    """A page's content as text and as Markdown, and the share of the page's characters that it has."""
    if page is None:
        return None, None, None
    tree = _Tree(page)
    e = tree.e
    lines: dict[int, list[tuple[str, int]]] = {}  # by run of one block: its pieces with their owners
    order: list[int] = []
    last, run = None, -1
    ranges = [e.pieces(x) if x else (0, len(tree.text)) for x in tree.content()]
    taken = -1
    for low, high in ranges:
        for i in range(max(low, taken), high):
            owner = e.owners[i]
            if tree.out[owner]:
                continue
            block = tree.block[owner]
            if block != last:
                run += 1
                last = block
                order.append(block)
                lines[run] = []
            lines[run].append((tree.text[i], i))
        taken = max(taken, high)
    breaks = [x for x in range(len(e.tags)) if e.tags[x] == "br"]
    texts, marked, kept = [], [], 0
    for k, block in enumerate(order):
        plain, shown = [], []
        for text, i in lines[k]:
            if plain and _between(breaks, e.before[i - 1], e.before[i]):
                plain.append(" ")
                shown.append(" ")
            plain.append(text)
            link = _link_of(e, e.owners[i])
            shown.append(f"[{' '.join(text.split())}]({link})" if link and text.strip(SPACE) else text)
        line = " ".join("".join(plain).split())
        linked = sum(_shown(text) for text, i in lines[k] if tree.linked[e.owners[i]])
        if not line or (linked > LINKED * _shown(line) and e.tags[block] not in HEADINGS):
            continue
        kept += _shown(line)
        texts.append(line)
        marked.append({"li": "- "}.get(e.tags[block], HEADINGS.get(e.tags[block], "") + " ").lstrip() + " ".join("".join(shown).split()))
    if not texts:
        return None, None, None
    return "\n".join(texts), "\n".join(marked), kept / tree.all


def _between(places: list[int], low: int, high: int) -> list[int]:
    return places[bisect_left(places, low) : bisect_left(places, high)]


def _link_of(e: Elements, x: int) -> str | None:
    while x:
        if e.tags[x] == "a":
            return e.attributes[x].get("href")
        x = e.parents[x]
    return None


def _contents(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in pages:
        yield pd.DataFrame([content_of(page) for page in part], columns=["text", "markdown", "share"], index=part.index)


def content(html: Column) -> Column:
    """text, markdown and share of a page's content."""
    ship_package()
    return F.pandas_udf(_contents, CONTENT)(html)
