"""Which parts of a page a site's selectors name. Parts are slices of the page's source; nothing is converted here."""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end when another one of the set begins beside them.
_SIBLINGS = [{"li"}, {"p"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}]


@dataclass
class Element:
    """An element and where its tags and its inner part lie in the source."""

    tag: str
    parent: Element | None
    id: str | None
    names: set[str] = field(default_factory=set)
    begin: int = 0
    inner: int = 0
    inner_end: int = 0
    end: int = 0

    def within(self, other: Element) -> bool:
        return other.inner <= self.begin and self.end <= other.inner_end


class Page(HTMLParser):
    """The elements of a page in document order."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=False)
        self.source = source
        self.elements: list[Element] = []
        self._lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self._open: list[Element] = []
        self.feed(source)
        self.close()
        self._close(0, len(source), len(source))

    def _here(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def _close(self, depth: int, inner_end: int, end: int) -> None:
        """Ends the open elements from this depth on. Only the first of them has an end tag."""
        for e in self._open[depth:]:
            e.inner_end = e.end = inner_end
        if depth < len(self._open):
            self._open[depth].end = end
        del self._open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = self._here()
        if self._open and any({tag, self._open[-1].tag} <= group for group in _SIBLINGS):
            self._close(len(self._open) - 1, at, at)
        own = dict(attrs)
        inner = at + len(self.get_starttag_text() or "")
        e = Element(tag, self._open[-1] if self._open else None, own.get("id"), set((own.get("class") or "").split()), at, inner, inner, inner)
        self.elements.append(e)
        if tag not in _VOID:
            self._open.append(e)

    def handle_endtag(self, tag: str) -> None:
        for depth in reversed(range(len(self._open))):
            if self._open[depth].tag == tag:
                at = self._here()
                self._close(depth, at, self.source.find(">", at) + 1 or len(self.source))
                return

    def select(self, selector: str | None, inside: Element | None = None) -> Iterator[Element]:
        """Elements that fit a selector of tags, #ids and .classes, joined by blanks and >."""
        if not (selector or "").strip():
            return
        steps = [(part == ">", part) for part in re.sub(r"\s*>\s*", " > ", selector.strip()).split()]
        for e in self.elements:
            if (inside is None or (e is not inside and e.within(inside))) and _fits(e, steps):
                yield e

    def outer(self, e: Element) -> str:
        return self.source[e.begin : e.end]

    def inner(self, e: Element) -> str:
        return self.source[e.inner : e.inner_end]

    def without(self, e: Element, gone: list[Element]) -> str:
        """What an element holds, but for these elements in it."""
        out, at = [], e.inner
        for g in sorted(gone, key=lambda g: g.begin):
            if g.begin >= at:
                out.append(self.source[at : g.begin])
                at = g.end
        return "".join([*out, self.source[at : e.inner_end]])


def _fits(e: Element | None, steps: list[tuple[bool, str]]) -> bool:
    """Whether the last step fits the element, and the steps before it what it lies in."""
    if e is None or not _alone(e, steps[-1][1]):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    if rest[-1][0]:
        return _fits(e.parent, rest[:-1])
    above = e.parent
    while above is not None and not _fits(above, rest):
        above = above.parent
    return above is not None


def _alone(e: Element, compound: str) -> bool:
    tag, *marks = re.split(r"(?=[.#])", compound)
    if tag not in ("", "*") and tag.lower() != e.tag:
        return False
    return all(m[1:] == e.id if m[0] == "#" else m[1:] in e.names for m in marks)


def strings(source: str) -> list[str]:
    """The texts between tags, decoded and stripped; none is empty."""
    bare = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", source)
    return [t for t in (html.unescape(x).strip() for x in re.split(r"<[^>]*>", bare)) if t]


def crumbs(page: Page, selector: str | None, from_text: bool) -> list[str]:
    """The items of the first element that fits; without items, if asked for, its text cut at >."""
    for nav in page.select(selector):
        items = [t for t in ("".join(strings(page.inner(e))) for e in page.select("li", nav)) if t]
        if not items and from_text:
            items = [t for t in (x.strip() for x in "".join(strings(page.inner(nav))).split(">")) if t]
        return items
    return []


def _outermost(found: list[Element], wanted: Callable[[Element], bool]) -> list[Element]:
    out: list[Element] = []
    ends: list[int] = []
    for e in found:
        if (not ends or bisect.bisect_right(ends, e.begin) == len(ends)) and wanted(e):
            out.append(e)
            ends.append(e.end)
    return out


#: What marks an item of an accordion, and the class beginnings of tabs.
ACCORDION_TEXTS = ("Accordion Item", "Closed Title")
TAB, TABS, TAB_TITLES, INTRO = "kt-inner-tab-", ".kt-tabs-content-wrap", ".kt-tabs-title-list", ".doc-content-wrap > p"


def accordions(page: Page, box: Element) -> list[Element]:
    """Items of accordions: details, and classes that hold accordion or collapse, if their text has the marks of an item."""
    named = [e for e in page.elements if e is not box and e.within(box) and (e.tag == "details" or any("accordion" in n or "collapse" in n for n in e.names))]
    return _outermost(named, lambda e: any(mark in " ".join(strings(page.outer(e))) for mark in ACCORDION_TEXTS))


def tabs(page: Page, box: Element) -> tuple[str | None, list[tuple[str, str]], list[Element]]:
    """Text of the introduction, (number, source) of each tab, and the elements that all of it takes out of the box."""
    intro = next(page.select(INTRO, box), None)
    wrap = next(page.select(TABS, box), None)
    titles = next(page.select(TAB_TITLES, box), None)
    steps = []
    if wrap is not None:
        for e in page.elements:
            if e.within(wrap) and (number := next((n[len(TAB) :] for n in sorted(e.names) if n.startswith(TAB)), "")):
                steps.append((number, page.outer(e)))
    gone = [e for e in (intro, wrap, titles) if e is not None]
    return None if intro is None else " ".join(strings(page.inner(intro))), steps, gone
