"""A small, forgiving reader of HTML pages: elements, their labels and their text in page order."""

from __future__ import annotations

import html
import re
import sys
from collections import Counter

#: Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements an opening tag closes, and the ancestors beyond which it does not reach.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
P_CLOSERS = BLOCKS - {"body", "html", "caption", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "title"}
P_SCOPE = {"table", "td", "th", "caption", "button", "object", "html"}

#: Elements whose content is not markup.
RAW = set("script style noscript template iframe textarea title svg xmp".split())
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_RAW_NAME = re.compile(r"(?:" + "|".join(sorted(RAW)) + r")\b", re.I)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


_NONE: dict[str, str] = {}


def attributes(text: str) -> dict[str, str]:
    if not text or text.isspace() or text == "/":
        return _NONE
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _tag_end(source: str, at: int) -> int:
    """The place after a tag's closing bracket, which may stand in quotes; -1 if there is none.

    A quote without an end does not count as one, so that every tag ends at some bracket after it.
    """
    first = source.find(">", at)
    while first >= 0:
        stop = _STOP.search(source, at)
        if stop is None:
            break
        if stop[0] == ">":
            return stop.end()
        at = source.find(stop[0], stop.end()) + 1
        if not at:
            break
    return first + 1 if first >= 0 else -1


class Page:
    """``parent``, ``tag`` and ``attrs`` of every element, and text runs ``(block, element, text)``.

    Elements are numbered in page order, so parents come before children; 0 is the page itself. A
    block number rises at every block boundary. Scripts, styles and comments give no text.
    """

    def __init__(self, source: str | None):
        self.parent, self.tag, self.attrs = [0], [""], [{}]
        self.runs: list[tuple[int, int, str]] = []
        self._block = 0
        self._opened: Counter[str] = Counter()
        stack = [0]
        at, look = 0, 0
        source = source or ""
        self._last = source.rfind(">")
        # One pass: a place where no markup begins is text, and no place is looked at twice.
        while (start := source.find("<", look)) >= 0:
            end, tag, attrs = self._markup(source, start)
            if end < 0:
                look = start + 1
                continue
            if start > at:
                self._text(stack[-1], source[at:start])
            at = look = end
            if tag.startswith("/"):
                self._close(stack, tag[1:])
            elif tag:
                self._open(stack, tag, attrs)
        if at < len(source):
            self._text(stack[-1], source[at:])

    def _markup(self, source: str, start: int) -> tuple[int, str, str]:
        """End of the markup at ``start`` (-1: none), and the name and attributes of a tag."""
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            return (end + 3 if end >= 0 else len(source)), "", ""
        if start >= self._last:
            return -1, "", ""
        raw = _RAW_NAME.match(source, start + 1)
        if raw:
            end = _tag_end(source, raw.end())
            return self._after_raw(source, end, raw[0].lower()), "", ""
        name = _NAME.match(source, start + 1)
        if name:
            end = _tag_end(source, name.end())
            return end, name[0].lower(), source[name.end() : end - 1]
        if source[start + 1 : start + 2] in ("!", "?", "/"):
            return source.find(">", start) + 1, "", ""
        return -1, "", ""

    def _after_raw(self, source: str, at: int, tag: str) -> int:
        close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
        return close.end() if close else len(source)

    def _text(self, node: int, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.runs.append((self._block, node, text))

    def _until(self, stack: list[int], found: set[str], scope: set[str]) -> None:
        """Close the nearest open element of ``found``, unless one of ``scope`` lies between."""
        if not any(self._opened[tag] for tag in found):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in found:
                self._leave(stack, i)
                return
            if tag in scope:
                return

    def _open(self, stack: list[int], tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self._block += 1
        if tag in P_CLOSERS:
            self._until(stack, {"p"}, P_SCOPE)
        if tag in CLOSES:
            self._until(stack, *CLOSES[tag])
        node = len(self.parent)
        self.parent.append(stack[-1])
        self.tag.append(sys.intern(tag))
        self.attrs.append(attributes(attrs))
        if tag == "br":
            self.runs.append((self._block, stack[-1], " "))
        if tag not in VOID:
            stack.append(node)
            self._opened[tag] += 1

    def _close(self, stack: list[int], tag: str) -> None:
        if tag in BLOCKS:
            self._block += 1
        if not self._opened[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == tag:
                self._leave(stack, i)
                return

    def _leave(self, stack: list[int], at: int) -> None:
        for node in stack[at:]:
            self._opened[self.tag[node]] -= 1
        del stack[at:]
