"""Leaf text blocks of a web page, in page order, with their ancestors."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

#: HTML elements whose content is no text of the page.
HIDDEN = ("script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "audio", "video", "canvas", "select", "textarea")
#: Elements that stay inside a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open element of these names, up to the nearest container.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSED_BY_BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
HOLDERS = frozenset("ul ol dl table body html div section article main nav aside header footer form td th blockquote".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in HIDDEN}


class Element:
    """An open element; its chain of parents is the path of the blocks in it.

    new: the features of tag and names (of class, id and role) that no ancestor has, so a path's features are the
    sum of its elements' own. main: whether it or an ancestor is labelled as main text.
    """

    __slots__ = ("parent", "tag", "new", "main", "score")

    def __init__(self, parent: Element | None, tag: str, new: tuple[str, ...], main: bool):
        self.parent, self.tag, self.new, self.main = parent, tag, new, main
        self.score: float | None = None


class Block(NamedTuple):
    text: str
    #: the innermost open element
    inside: Element | None
    linked: int

    @property
    def main(self) -> bool:
        return self.inside is not None and self.inside.main


class _Stack:
    """Open elements, and where each tag stands among them, so that no search walks the stack."""

    def __init__(self):
        self.elements: list[Element] = []
        self.at: dict[str, list[int]] = {}
        self.holders: list[int] = []
        self.seen: Counter[str] = Counter()
        self.features: list[tuple[str, ...]] = []

    def top(self) -> Element | None:
        return self.elements[-1] if self.elements else None

    def push(self, tag: str, names: list[str], main: bool) -> None:
        own = tuple(dict.fromkeys([f"t:{tag}", *(f"c:{x}" for x in names)]))
        up = self.top()
        self.elements.append(Element(up, tag, tuple(f for f in own if not self.seen[f]), main or (up is not None and up.main)))
        self.seen.update(own)
        self.features.append(own)
        if tag in HOLDERS:
            self.holders.append(len(self.elements) - 1)
        self.at.setdefault(tag, []).append(len(self.elements) - 1)

    def cut(self, place: int) -> None:
        """Close the elements from a place on."""
        while len(self.elements) > place:
            tag = self.elements.pop().tag
            self.seen.subtract(self.features.pop())
            self.at[tag].pop()
            if tag in HOLDERS:
                self.holders.pop()

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost element of these tags, -1 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page, in time linear in its length; malformed markup is read as far as it goes."""
    out: list[Block] = []
    stack = _Stack()
    text: list[str] = []
    endless: set[str] = set()  # hidden elements that have no further end tag
    linked = links = at = 0

    def end_block() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, stack.top(), min(linked, len(whole))))
            text.clear()
        linked = 0

    while m := _TOKEN.match(page, at):
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if tag is None:
            if m[0][:2] not in ("<!", "<?"):
                text.append(m[0])
                if links:
                    linked += len(m[0].strip())
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        if not closing and tag in _ENDS and not attributes.endswith("/"):
            end = None if tag in endless else _ENDS[tag].search(page, at)
            if end is None:
                endless.add(tag)
            # an unclosed head or title hides no page
            if end or tag not in ("head", "title"):
                at = end.end() if end else len(page)
            text.append(" ")
            continue
        end_block()
        links = 0
        if closing:
            if (place := stack.last((tag,))) >= 0:
                stack.cut(place)
            continue
        place = stack.last(CLOSES.get(tag, ("p",) if tag in CLOSED_BY_BLOCK else ()))
        if place >= 0 and place >= (stack.holders[-1] if stack.holders else 0):
            stack.cut(place)
        if tag not in VOID and not attributes.endswith("/"):
            names: list[str] = []
            main = False
            for a in _ATTRIBUTE.finditer(attributes):
                if a[1].lower() == "data-main":
                    main = True
                else:
                    names += [x.lower() for x in _PART.findall(a[2] or a[3] or a[4] or "")]
            stack.push(tag, names, main)
    end_block()
    return out
