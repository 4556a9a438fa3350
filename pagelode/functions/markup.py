"""Pages as a tree of elements, by a walk over their tags: what HTML closes by itself is closed, end tags without a start are ignored."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter

# Fixed values of HTML: elements without an end tag, and those whose text is no markup.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
RAW = ["script", "style", "textarea", "title"]
#: Fixed values of HTML: an element that begins closes one of these that is still open in its parent.
CLOSED_BY = {
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"],
    **{x: ["p"] for x in ("p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "blockquote")},
}
#: Elements that closing by the next one doesn't reach through.
_WALLS = frozenset(["table", "ul", "ol", "dl", "td", "th", "select", "div", "section", "article", "body", "html"])

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>`]+)))?")
SPACE = " \t\n\f\r"


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


class Elements:
    """Elements in page order, each with its tag, attributes, parent and the end of its subtree, and the page's texts by place.

    Element 0 is the page itself. The subtree of e is the elements from e up to ends[e]; its texts begin behind the last piece before e."""

    def __init__(self, page: str) -> None:
        self.tags, self.attributes, self.ends, self.parents = [""], [{}], [0], [0]
        #: Pieces of text, the element that would begin behind each, and of each element how many pieces there are where it ends.
        self.texts, self.before, self.owners, self.until = [], [], [], [0]
        self.stack, self.open = [0], Counter()
        at, token = 0, _TOKEN.search(page)
        while token:
            self._text(page[at : token.start()])
            at = token.end()
            tag = (token[2] or "").lower()
            if tag and token[1]:
                if self.open[tag]:
                    self._close(max(d for d in range(len(self.stack)) if self.tags[self.stack[d]] == tag) if self.tags[self.stack[-1]] != tag else len(self.stack) - 1)
            elif tag:
                self._close(self._kept(tag))
                self.parents.append(self.stack[-1])
                self.stack.append(len(self.tags))
                self.open[tag] += 1
                self.tags.append(tag)
                self.attributes.append(_attributes(token[3]))
                self.ends.append(0)
                self.until.append(0)
                if tag in VOID:
                    self._close(len(self.stack) - 1)
                elif tag in RAW:
                    end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
                    if tag in ("textarea", "title"):
                        self._text(page[at : end.start() if end else len(page)])
                    at = end.start() if end else len(page)
            token = _TOKEN.search(page, at)
        self._text(page[at:])
        self._close(0)

    def _text(self, piece: str) -> None:
        if piece:
            self.texts.append(piece)
            self.before.append(len(self.tags))
            self.owners.append(self.stack[-1])

    def _kept(self, tag: str) -> int:
        """How many open elements stay when an element of this tag begins."""
        ended = CLOSED_BY.get(tag, ())
        kept = len(self.stack)
        if not any(self.open[x] for x in ended):
            return kept
        for depth in range(len(self.stack) - 1, 0, -1):
            inner = self.tags[self.stack[depth]]
            if inner in ended:
                kept = depth
                if inner == tag or tag != "tr":
                    break
            elif inner in _WALLS:
                break
        return kept

    def _close(self, depth: int) -> None:
        for element in self.stack[depth:]:
            self.ends[element], self.until[element] = len(self.tags), len(self.texts)
            self.open[self.tags[element]] -= 1
        del self.stack[depth:]

    def pieces(self, element: int) -> tuple[int, int]:
        """The range of texts in an element."""
        return bisect_right(self.before, element), self.until[element]

    def text(self, element: int) -> str:
        low, high = self.pieces(element)
        return entities.unescape("".join(self.texts[low:high])).strip(SPACE)
