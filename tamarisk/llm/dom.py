"""A small DOM: elements as arrays, and text in blocks, from HTML as it is found."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Their contents are never text of the page.
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "select", "textarea", "button"}
#: What a head may hold. Anything else ends it, as its end tag may be left out.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template", "head", "html"}
MATH = {
    "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "menclose", "mfenced", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts",
    "none", "mtable", "mtr", "mlabeledtr", "mtd", "maction", "semantics", "annotation", "annotation-xml",
}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "object", "param"} | MATH
#: Elements in which a start tag may end itself.
FOREIGN = {"svg", "math"}
#: A start tag of the first closes an open element of the second, unless one of the third stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
_SPACE = re.compile(r"\s+")
#: Beyond every code point, and too long for int().
_LONG_REF = re.compile(r"&#[0-9]{4000,};?")
_COMMENT_END = re.compile(r"--!?>")


class Dom(HTMLParser):
    """After feed and close: parent, tag, names (words of class, id and role) and mark of each element; chunks (block, element, text).

    Where a tag is open is looked up, never searched for, so that deep pages take time in proportion to their length.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.mark = [-1], ["#page"], [""], [""]
        self.open = [0]
        #: Places in open by tag; of elements that are not inline; of silent and of foreign ones.
        self.places: dict[str, list[int]] = {}
        self.not_inline: list[int] = []
        self.silent = self.foreign = 0
        self.block = 0
        self.chunks: list[tuple[int, int, str]] = []

    def _push(self, element: int) -> None:
        tag = self.tag[element]
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.not_inline.append(len(self.open))
        self.silent += tag in SILENT
        self.foreign += tag in FOREIGN
        self.open.append(element)

    def _close_from(self, place: int) -> None:
        """Close the elements from this place in open on."""
        while len(self.open) > place:
            tag = self.tag[self.open.pop()]
            self.places[tag].pop()
            if tag not in INLINE:
                self.not_inline.pop()
            self.silent -= tag in SILENT
            self.foreign -= tag in FOREIGN

    def _last(self, tags: set[str]) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((held[-1] for t in tags if (held := self.places.get(t))), default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self._leave({"head"}, set())
        elif tag not in HEAD:
            self._end_head()
        if tag == "br" or tag == "wbr":
            self.chunks.append((self.block, self.open[-1], " " if tag == "br" else ""))
            return
        block = tag not in INLINE
        if block:
            self._leave({"p"}, {"button", "object", "table", "td", "th"})
            self.block += 1
        if tag in CLOSES:
            self._leave(*CLOSES[tag])
        if tag in VOID:
            return
        found = dict(attrs)
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.names.append(" ".join(v for k in ("class", "id", "role") if (v := found.get(k))))
        self.mark.append(found.get("data-y") or "")
        self._push(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.foreign:
            self.handle_endtag(tag)

    # The whole page is fed at once, so what has no end goes on to the end of the page, as in browsers, and is never text.

    def _through(self, i: int) -> int:
        """Behind the next '>'."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """`<!-->` and `<!--->` are whole comments; others end at `-->` or `--!>`."""
        for short in (">", "->"):
            if self.rawdata.startswith(short, i + 4):
                return i + 4 + len(short)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """To the next '>', whatever is declared; the parser itself stops at names that it doesn't know."""
        return self._through(i)

    def parse_bogus_comment(self, i: int, report: int = 1) -> int:
        return self._through(i)

    def parse_pi(self, i: int) -> int:
        return self._through(i)

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def handle_endtag(self, tag: str) -> None:
        place = self._last({tag})
        outer = self.not_inline[-1] if self.not_inline else 0
        if not place or tag in INLINE and tag not in ("math", "object") and outer > place:
            return  # an inline end tag doesn't reach beyond its block
        if outer >= place:
            self.block += 1
        self._close_from(place)

    def _leave(self, tags: set[str], within: set[str]) -> None:
        place = self._last(tags)
        if place and place > self._last(within):
            self._close_from(place)
            self.block += 1

    def _end_head(self) -> None:
        if self.tag[self.open[-1]] == "head":
            self._close_from(len(self.open) - 1)
            self.block += 1

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not self.silent:
            self.chunks.append((self.block, self.open[-1], data))


def parse(html: str) -> Dom:
    dom = Dom()
    dom.feed(_LONG_REF.sub("\ufffd", html))
    dom.close()
    return dom


def joined(chunks: list[tuple[int, int, str]]) -> str:
    """Blocks in page order, white space as one space, two line ends between blocks."""
    blocks: dict[int, list[str]] = {}
    for block, _, text in chunks:
        blocks.setdefault(block, []).append(text)
    return "\n\n".join(t for parts in blocks.values() if (t := _SPACE.sub(" ", "".join(parts)).strip()))
