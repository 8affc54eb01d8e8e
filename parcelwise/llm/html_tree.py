"""A page as a tree of blocks, in arrays: one pass over the text, linear in its length whatever its markup.

Only elements that break a line become nodes; inline elements are transparent, so their missing end tags do no harm.
Text directly inside an element, between two such elements, is a node of its own: a run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Fixed values of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HIDDEN = frozenset("noscript template svg math object audio video canvas datalist map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEPT_ATTRIBUTES = frozenset("id class role itemprop aria-label name".split())
#: An open element of the set ends where one of the named kind begins.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody"},
    "tfoot": {"td", "th", "tr", "tbody"}, "option": {"option"},
}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?)""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RUN = "#run"


@dataclass
class Page:
    """Nodes in page order; a node's subtree is ``range(i, end[i])``."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, tokens: tuple[str, ...] = (), text: str = "", linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.end.append(len(self.tag))
        self.tokens.append(tokens)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


class _Builder:
    def __init__(self) -> None:
        self.page = Page()
        self.open = [self.page.add("html", -1)]
        self.count = {"html": 1}
        self.pieces: list[str] = []
        self.linked, self.links, self.hidden = 0, 0, []

    def write(self, text: str) -> None:
        if self.hidden or not text:
            return
        text = unescape(text)
        self.pieces.append(text)
        if self.links:
            self.linked += len(text.strip())

    def close_run(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.page.add(RUN, self.open[-1], (), text, min(self.linked, len(text)))
            self.pieces = []
        self.linked = 0

    def pop(self) -> None:
        node = self.open.pop()
        self.page.end[node] = len(self.page.tag)
        self.count[self.page.tag[node]] -= 1

    def begin(self, name: str, attributes: list[tuple[str, str]]) -> None:
        if self.hidden:
            if name == self.hidden[0]:
                self.hidden.append(name)
            return
        if name in HIDDEN:
            self.hidden.append(name)
        elif name == "a":
            self.links = 1  # links do not nest
        elif name == "br":
            self.pieces.append(" ")
        elif name in BLOCKS:
            self.close_run()
            self.links = 0
            tags = self.page.tag
            if tags[self.open[-1]] == "p":
                self.pop()
            while tags[self.open[-1]] in ENDS.get(name, ()):
                last = tags[self.open[-1]]
                self.pop()
                if last == name:
                    break
            if name in ("html", "body") and self.count.get(name):
                return
            tokens = tuple(t.lower() for key, value in attributes if key in KEPT_ATTRIBUTES for t in _TOKEN.findall(value))
            node = self.page.add(name, self.open[-1], tokens)
            if name not in VOID:
                self.open.append(node)
                self.count[name] = self.count.get(name, 0) + 1

    def finish(self, name: str) -> None:
        if self.hidden:
            if name == self.hidden[0]:
                self.hidden.pop()
        elif name == "a":
            self.links = 0
        elif name in BLOCKS:
            self.close_run()
            # What follows the end of the body still belongs to it.
            if name not in ("html", "body") and self.count.get(name):
                while self.page.tag[self.open[-1]] != name:
                    self.pop()
                self.pop()


def parse(html: str) -> Page:
    """The page's blocks; an unfinished tag, comment or raw text at the end is dropped."""
    build, at, size = _Builder(), 0, len(html)
    while at < size:
        low = html.find("<", at)
        if low < 0:
            build.write(html[at:])
            break
        build.write(html[at:low])
        follows = html[low + 1 : low + 2]
        if follows == "!" or follows == "?":
            comment = html.startswith("<!--", low)
            high = html.find("-->", low + 2) if comment else html.find(">", low)
            if high < 0:
                break
            at = high + (3 if comment else 1)
        elif follows == "/":
            name = _NAME.match(html, low + 2)
            high = html.find(">", low)
            if high < 0:
                break
            if name:
                build.finish(name.group().lower())
            at = high + 1
        elif name := _NAME.match(html, low + 1):
            tag, at, attributes = name.group().lower(), name.end(), []
            closed = False
            while found := _ATTRIBUTE.match(html, at):
                at = found.end()
                if found.group(1):
                    closed = True
                    break
                attributes.append((found.group(2).lower(), found.group(3) or found.group(4) or found.group(5) or ""))
            if not closed:
                break
            if tag in RAW:
                over = _RAW_END[tag].search(html, at)
                if not over:
                    break
                at = over.start()
                high = html.find(">", at)
                at = size if high < 0 else high + 1
            else:
                build.begin(tag, attributes)
        else:
            build.write("<")
            at = low + 1
    build.close_run()
    while build.open:
        build.pop()
    return build.page
