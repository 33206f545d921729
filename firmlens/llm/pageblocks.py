"""Leaf blocks of an HTML page: the text runs between block-level tags, each with its tag path."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

#: fixed values of the HTML standard: elements without content, elements whose content is not read as text (not rendered, or part of a
#: form control), elements inside a line
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("audio button canvas datalist head iframe math meter noembed noframes noscript object output progress script select style svg template textarea title video".split())
INLINE = (UNSEEN - {"head"}) | frozenset(
    "a abbr acronym area b bdi bdo big br cite code data del dfn em embed font i img input ins kbd label link map mark meta nobr param picture q rp rt ruby s samp slot small source span strike strong sub sup time track tt u var wbr".split()
)
#: what may stand in a head; anything else ends it
METADATA = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: drawings and formulas: their elements make no blocks. A start tag of BREAKS ends them, except inside the elements of HOSTS
FOREIGN = frozenset("svg math".split())
BREAKS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOSTS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: an opening tag that ends these open elements when it comes right inside them
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: ancestors kept for a block: so many outermost and so many innermost
ENDS = 24
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    linked: int


class _Reader(HTMLParser):
    """Keeps the places of open elements by name, so that no tag looks through the open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name
        self.walls: list[int] = []  # places of the open elements that are no part of a line
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.at: tuple[tuple[str, tuple[str, ...]], ...] = ()
        self.unseen = 0
        self.foreign: int | None = None  # place of the outermost open svg or math

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(self.at, text, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, index: int) -> None:
        for tag, _ in reversed(self.open[index:]):
            self.unseen -= tag in UNSEEN
            self.places[tag].pop()
        del self.open[index:]
        while self.walls and self.walls[-1] >= index:
            self.walls.pop()
        if self.foreign is not None and index <= self.foreign:
            self.foreign = None

    def _last(self, tag: str) -> int:
        """Place of the innermost open element of the name, or -1."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _hosted(self) -> bool:
        """Whether an open element of the svg or math holds HTML."""
        return any(self._last(tag) >= self.foreign for tag in HOSTS)

    def _empty(self, tag: str) -> bool:
        """Whether a slash closes the start tag: in svg and math only, there also one that ends an unquoted value."""
        return (tag in FOREIGN or self.foreign is not None) and self.get_starttag_text().endswith("/>") and (tag in FOREIGN or not self._hosted())

    def _close_before(self, tag: str) -> None:
        """End open paragraphs, and the element that the block tag ends if it comes right inside it."""
        while self.walls:
            i = self.walls[-1]
            name = self.open[i][0]
            if name == "p":
                self._pop(i)
                continue
            if name in CLOSES.get(tag, ()):
                self._pop(i)
            break

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.places["head"]:
            self._pop(self.places["head"][0])
        elif tag not in METADATA and self.open and self.open[-1][0] == "head":
            self._pop(len(self.open) - 1)
        if self.foreign is not None and tag in BREAKS and not self._hosted():
            self._pop(self.foreign)
        if self.unseen or self.foreign is not None:
            pass
        elif tag not in INLINE:
            self.flush()
            self._close_before(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID or self._empty(tag):
            return
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role", "itemprop"))
        words = tuple(w.lower() for w in _WORD.findall(named))
        if any(k == "hidden" or (k == "style" and "display:none" in (v or "").replace(" ", "")) for k, v in attrs):
            words += ("hidden",)
        if self.foreign is None and tag in FOREIGN:
            self.foreign = len(self.open)
        if tag not in INLINE:
            self.walls.append(len(self.open))
        self.places[tag].append(len(self.open))
        self.open.append((tag, words))
        self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = self._last(tag)
        if self.foreign is not None and at >= self.foreign:
            self._pop(at)
            return
        # what is opened inside an unread element ends there; an element around it ends it too
        if tag not in INLINE and not (self.unseen and (at < 0 or self._unread(at))):
            self.flush()
        if at < 0 or (tag in INLINE and tag not in UNSEEN and self.walls and self.walls[-1] > at):
            return
        self._pop(at)

    def _unread(self, place: int) -> bool:
        """Whether the element at the place stands inside an unread one."""
        return any(0 <= places[0] < place for tag in UNSEEN if (places := self.places.get(tag)))

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._pop(len(self.open) - 1)
        if self.unseen:
            return
        if not self.parts or not "".join(self.parts[-1:]).strip():
            self.at = tuple(self.open if len(self.open) <= 2 * ENDS else self.open[:ENDS] + self.open[-ENDS:])
        self.parts.append(data)
        if any(tag == "a" for tag, _ in self.open[-4:]):
            self.linked += len(data.strip())


def blocks(html: str | None) -> list[Block]:
    """Rendered text blocks in page order; character references decoded, white space runs one space, empty blocks left out."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks
