"""Text blocks of an HTML page in order, each with the path of open tags it stands in.

A small tolerant reader: it knows raw-text elements, void tags, tags that close others by
opening, and ends that match nothing. Character references are decoded and white space inside a
block becomes one blank. Left out are scripts, styles, the head, templates, and the inside of form
controls; all other text is in a block.

Time and memory grow in proportion to the page, whatever its markup: places of open tags are kept
by name, paths share their outer parts, and what is known not to end is not searched again.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

# Fixed values of HTML: elements without content, raw-text elements that are left out, elements whose text is left out,
# elements that start and end a block, elements whose text is a block of its own though they can stand in a sentence,
# elements of the head, and elements that close an open one of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("head template select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
ALONE = frozenset("noscript object canvas audio video iframe noembed noframes text desc foreignobject".split())
IN_HEAD = frozenset("base basefont bgsound html head link meta noscript script style template title".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ENDS_FAR = BLOCK | HIDDEN | ALONE | {"math", "svg"}
ENDS_P = BLOCK - {"html", "body", "button", "label", "legend", "caption", "option", "tbody", "thead", "tfoot", "tr", "td", "th"}

_TAG = re.compile(
    r"<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)>")
_COMMENT_END = re.compile(r"--!?>")
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|data-keep)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Path:
    """Open tags from the outside in, each with the words of its names; the outer ones are shared with other paths."""

    __slots__ = ("outer", "tag", "names", "depth", "near", "slots")

    def __init__(self, outer: Path | None = None, tag: str = "", names: tuple[str, ...] = ()) -> None:
        self.outer, self.tag, self.names = outer, tag, names
        self.depth = outer.depth + 1 if outer else 0
        near = outer.near if outer else ()
        #: The innermost three block elements, from the inside out.
        self.near = ((tag, names), *near)[:3] if tag in BLOCK else near
        self.slots: tuple | None = None


@dataclass
class Block:
    """Text without outer white space, the tags it stands in, and letters in links."""

    text: str
    path: Path
    linked: int
    marked: bool = False


@dataclass
class _Open:
    tag: str
    path: Path
    marked: bool


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    walls: list[int] = field(default_factory=list)  # places of open block elements
    pieces: list[str] = field(default_factory=list)
    outside: Path = field(default_factory=Path)
    linked: int = 0
    hidden: int = 0
    marked: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(Block(text, self.stack[-1].path if self.stack else self.outside, self.linked, self.marked > 0))
        self.pieces, self.linked = [], 0

    def add(self, raw: str, decode: bool = True) -> None:
        if self.hidden or not raw:
            return
        text = html.unescape(raw) if decode and "&" in raw else raw
        self.pieces.append(text)
        if self.places["a"]:
            self.linked += len(text.strip())

    def push(self, tag: str, names: tuple[str, ...], marked: bool) -> None:
        self.places[tag].append(len(self.stack))
        if tag in BLOCK:
            self.walls.append(len(self.stack))
        self.marked += marked
        self.stack.append(_Open(tag, Path(self.stack[-1].path if self.stack else self.outside, tag, names), marked))

    def pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            gone = self.stack.pop()
            self.places[gone.tag].pop()
            if gone.tag in BLOCK:
                self.walls.pop()
            self.hidden -= gone.tag in HIDDEN
            self.marked -= gone.marked

    def open(self, tag: str, rest: str) -> None:
        if self.hidden and tag not in IN_HEAD:  # what cannot stand in the head ends it
            for k, o in enumerate(self.stack[:3]):
                if o.tag == "head":
                    self.pop_to(k)
                    break
        if tag in BLOCK or tag in ALONE:
            self.flush()
        elif tag in ("br", "wbr", "img", "input"):
            self.add(" " if tag != "wbr" else "")
        if tag in VOID:
            return
        if tag in ENDS_P and self.walls and self.stack[self.walls[-1]].tag == "p":
            self.pop_to(self.walls[-1])
        if tag in CLOSES:
            scope = max((self.places[t][-1] for t in SCOPES[tag] if self.places[t]), default=-1)
            inner = [places[k] for t in CLOSES[tag] if (k := bisect_right(places := self.places[t], scope)) < len(places)]
            self.pop_to(min(inner, default=len(self.stack)))
        names, marked = [], False
        if rest:
            for kind, *values in _NAMES.findall(rest):
                value = next((v for v in values if v), "")
                marked |= kind == "data-keep"
                if kind != "data-keep":
                    names += [w.lower() for w in _WORD.findall(value)]
        self.hidden += tag in HIDDEN
        if not rest.endswith("/") or tag not in ("svg", "math"):
            self.push(tag, tuple(names), marked)
        else:
            self.hidden -= tag in HIDDEN

    def close(self, tag: str) -> None:
        if tag in BLOCK or tag in ALONE:
            self.flush()
        if not self.places[tag]:
            return
        at = self.places[tag][-1]
        if tag in ENDS_FAR or tag == "a" or not self.walls or self.walls[-1] < at:
            self.pop_to(at)


class _Markup:
    """Finds tags, and skips comments and declarations."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.data = page, page.rfind(">"), page.rfind("]]>")

    def next(self, at: int) -> tuple[int, int, re.Match | None] | None:
        """Start and end of the next markup from a place on, and the tag if it is one."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                if page.startswith(("<!-->", "<!--->"), start):
                    return start, page.index(">", start) + 1, None
                end = _COMMENT_END.search(page, start + 4)
                return start, end.end() if end else len(page), None
            if start > self.last:
                return None
            if page.startswith("<![CDATA[", start) and self.data > start:
                return start, page.index("]]>", start) + 3, None
            if page.startswith(("<!", "<?"), start):
                return start, page.index(">", start) + 1, None
            found = _TAG.match(page, start)
            if found:
                return start, found.end(), found
            at = start + 1


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page; null and empty pages have none."""
    reader, at, page = _Reader(), 0, page or ""
    markup = _Markup(page)
    while True:
        span = markup.next(at)
        if not span:
            reader.add(page[at:])
            reader.flush()
            return reader.blocks
        reader.add(page[at : span[0]])
        at, found = span[1:]
        if not found:
            continue
        tag = found["tag"] or found["tag2"]
        tag, rest = tag.lower(), (found["rest"] if found["tag"] else found["rest2"]) or ""
        if found["end"] or found["end2"]:
            reader.close(tag)
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else len(page)
            if tag == "textarea":
                reader.add(" ")
        elif tag == "xmp":  # shown as it stands, markup and references included
            reader.open(tag, rest)
            end = re.compile(r"</xmp(?=[\s/>])", re.I).search(page, at)
            reader.add(page[at : end.start() if end else len(page)], decode=False)
            at = end.start() if end else len(page)
        else:
            reader.open(tag, rest)
