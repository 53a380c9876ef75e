"""A small, tolerant HTML reader: block elements as a tree, text pieces in page order. Never fails on broken markup."""

from __future__ import annotations

import html
import re

#: Elements whose text flows within a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no running text: not shown, or controls.
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button title".split())
#: Silent elements whose content is not markup; a missing end tag takes the rest of the page.
RAW = ("script", "style", "textarea", "title", "iframe", "noscript")
#: An open element of the first kind ends when one of the second begins.
_P_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s>/])[^>]*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile("[a-z]+")


class Page:
    """tag, parent (-1 for the root), depth, names (tokens of class, id and role) of each block element, in page order; pieces:
    (element, decoded text, text within links), and (element, None, False) at each block's bounds."""

    __slots__ = ("tag", "parent", "depth", "names", "pieces")

    def __init__(self, source: str | None):
        self.tag, self.parent, self.depth, self.names = ["#root"], [-1], [0], [()]
        self.pieces: list[tuple[int, str | None, bool]] = []
        if source:
            self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, inline ones with the block they are in
        links = silent = at = 0
        put = self.pieces.append
        for m in _TOKEN.finditer(source):
            if m.start() > at and not silent:
                text = source[at : m.start()]
                put((stack[-1][1], html.unescape(text) if "&" in text else text, links > 0))
            at = m.end()
            if m["raw"]:
                continue
            name = m["tag"] or m["tag2"]
            if not name:
                continue
            name = name.lower()
            if name == "br" or name == "hr":
                put((stack[-1][1], None, False))
                continue
            if name in VOID:
                continue
            inline = name in INLINE
            if m["end"] or m["end2"]:
                k = len(stack) - 1
                while k > 0 and stack[k][0] != name and not (inline and stack[k][0] not in INLINE):
                    k -= 1
                if k > 0 and stack[k][0] == name:
                    for x, _ in stack[k:]:
                        links -= x == "a"
                        silent -= x in SILENT
                    if not inline:
                        put((stack[k][1], None, False))
                    del stack[k:]
                    if not inline:
                        put((stack[-1][1], None, False))
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            if attrs.endswith("/") and name in SILENT:
                continue
            if not inline:
                ends = ("p",) if name in _P_ENDS else _SAME.get(name)
                if ends:
                    k = len(stack) - 1
                    while k > 0 and (stack[k][0] in INLINE or stack[k][0] in ends or ends == ("p",) and stack[k][0] == "p"):
                        k -= 1
                    # what is left above a remaining block are inline elements: they end only with an ended block
                    low = next((i for i in range(k + 1, len(stack)) if stack[i][0] in ends), None)
                    if low is not None:
                        for x, _ in stack[low:]:
                            links -= x == "a"
                            silent -= x in SILENT
                        del stack[low:]
                block = len(self.tag)
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.depth.append(self.depth[stack[-1][1]] + 1)
                self.names.append(tuple(w for a in _ATTR.findall(attrs) for w in _WORDS.findall((a[0] or a[1] or a[2]).lower())) if attrs else ())
                put((block, None, False))
                stack.append((name, block))
                silent += name in SILENT
            else:
                links += name == "a"
                stack.append((name, stack[-1][1]))
        if at < len(source) and not silent:
            rest = source[at:]
            put((stack[-1][1], html.unescape(rest) if "&" in rest else rest, links > 0))

    def text(self, keep=None) -> str:
        """The text of the elements for which ``keep`` is true (all without it): blocks in page order, white space as one space."""
        return " ".join("".join([" " if t is None else t for n, t, _ in self.pieces if t is None or keep is None or keep[n]]).split())

    def lines(self) -> str:
        """All text, a line for each block."""
        blocks = "".join(["\n" if t is None else t.replace("\n", " ") for _, t, _ in self.pieces]).split("\n")
        return "\n".join(x for b in blocks if (x := " ".join(b.split())))
