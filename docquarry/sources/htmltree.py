"""An HTML tree for documentation pages, tolerant of unclosed and misplaced tags.

Elements are kept in parallel lists in document order; an element's content is a
list of raw text pieces and element numbers. Optional end tags, void elements and
raw-text elements are handled; formatting elements left open when a block ends
are opened again inside the next one, as browsers do.
"""

from __future__ import annotations

import html as htmllib
import re

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd td th tr".split())
_TABLE_PARTS = frozenset("td th tr tbody thead tfoot table body html".split())
_CELLS = frozenset(["td", "th"])
#: An opening tag ends open elements of these names, up to the border.
IMPLIED_ENDS = {
    "li": [(frozenset(["li"]), frozenset(["ul", "ol", "menu", "table"]))],
    "dt": [(frozenset(["dt", "dd"]), frozenset(["dl", "table"]))],
    "dd": [(frozenset(["dt", "dd"]), frozenset(["dl", "table"]))],
    "td": [(_CELLS, frozenset(["tr", "table"]))],
    "th": [(_CELLS, frozenset(["tr", "table"]))],
    "tr": [(frozenset(["tr"]), frozenset(["table"]))],
    "thead": [(frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"]))],
    "tbody": [(frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"]))],
    "tfoot": [(frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"]))],
    "option": [(frozenset(["option"]), frozenset(["select"]))],
}
_P = frozenset(["p"])
_P_BORDER = frozenset("td th table button div li blockquote section article main aside dd body".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe|noscript)(?P<rattrs>(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(?P<text>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


_NONE: dict[str, str] = {}


class _Attributes(list):
    """Attributes of the elements, read when they are asked for."""

    def __getitem__(self, e: int) -> dict[str, str]:
        own = list.__getitem__(self, e)
        if type(own) is str:
            own = {}
            for k, a, b, c in _ATTRIBUTE.findall(list.__getitem__(self, e)):
                own.setdefault(k.lower(), htmllib.unescape(a or b or c))
            self[e] = own
        return own

    def naming(self, e: int, names: re.Pattern) -> dict[str, str]:
        """The attributes if ``names`` occurs in their text, else none."""
        own = list.__getitem__(self, e)
        return self[e] if type(own) is not str or names.search(own) else _NONE


class Tree:
    """Parallel lists ``tag``, ``up``, ``attrs`` and ``content``; element 0 is the root."""

    def __init__(self, text: str) -> None:
        self.tag: list[str] = ["#root"]
        self.up: list[int] = [-1]
        self.attrs = _Attributes([_NONE])
        self.content: list[list] = [[]]
        self._stack = [0]
        self._reopen: list[int] = []
        self._build(text)

    def _open(self, name: str, attrs: dict[str, str] | str) -> int:
        me, top = len(self.tag), self._stack[-1]
        self.content[top].append(me)
        self.tag.append(name)
        self.up.append(top)
        self.attrs.append(attrs)
        self.content.append([])
        return me

    def _restore(self) -> None:
        """Formatting elements cut off by the end of a block go on here."""
        for e in self._reopen:
            self._stack.append(self._open(self.tag[e], {k: v for k, v in self.attrs[e].items() if k != "id"}))
        self._reopen = []

    def _close(self, at: int, keep_formatting: bool) -> None:
        """Drop the stack from position ``at`` on."""
        if keep_formatting:
            self._reopen += [e for e in self._stack[at:] if self.tag[e] in FORMATTING]
        del self._stack[at:]

    def _end(self, names: frozenset, border: frozenset) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            t = self.tag[self._stack[i]]
            if t in names:
                self._close(i, True)
                return
            if t in border or t == "template":
                return

    def _end_tag(self, name: str) -> None:
        for e in reversed(self._reopen):
            if self.tag[e] == name:
                self._reopen.remove(e)
                return
        for i in range(len(self._stack) - 1, 0, -1):
            t = self.tag[self._stack[i]]
            if t == name:
                self._close(i, name not in FORMATTING)
                return
            if t == "template" or ((t in _CELLS or t == "table") and name not in _TABLE_PARTS):
                return

    def _build(self, text: str) -> None:
        at, tag, content, stack = 0, self.tag, self.content, self._stack
        for m in _MARKUP.finditer(text):
            start = m.start()
            if start > at:
                self._piece(text[at:start])
            at = m.end()
            raw, raw_attrs, inside, end, name, attrs = m.groups()
            if raw:
                name = raw
            elif not name:
                continue
            name = name.lower()
            if end:
                if tag[stack[-1]] == name and not self._reopen:
                    stack.pop()
                else:
                    self._end_tag(name)
                continue
            if len(stack) > 1 and tag[stack[-1]] == "head" and name not in HEAD_ONLY:
                stack.pop()
            if name in CLOSES_P:
                self._end(_P, _P_BORDER)
            for names, border in IMPLIED_ENDS.get(name, ()):
                self._end(names, border)
            if self._reopen and name not in CLOSES_P and name not in _TABLE_PARTS:
                self._restore()
            attrs = raw_attrs if raw else attrs
            me = self._open(name, attrs if attrs and not attrs.isspace() else _NONE)
            if raw:
                content[me].append(inside)
            elif name not in VOID:
                stack.append(me)
        if at < len(text):
            self._piece(text[at:])

    def _piece(self, text: str) -> None:
        if self._reopen and not text.isspace():
            self._restore()
        self.content[self._stack[-1]].append(text)

    def text(self, e: int, gap: str = "") -> str:
        """Text of a subtree with entities decoded; ``gap`` stands before each element's."""
        out: list[str] = []
        todo: list = [e]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                out.append(gap)
                todo.extend(reversed(self.content[x]))
        return htmllib.unescape("".join(out))

    def elements(self, e: int) -> list[int]:
        """Element children."""
        return [x for x in self.content[e] if not isinstance(x, str)]

    def below(self, e: int) -> list[int]:
        """All elements inside ``e`` in document order."""
        out, todo = [], self.elements(e)[::-1]
        while todo:
            x = todo.pop()
            out.append(x)
            todo.extend(self.elements(x)[::-1])
        return out

    def classes(self, e: int) -> list[str]:
        return self.attrs[e].get("class", "").split()


class Selector:
    """Compound and descendant CSS selectors: tag, ``*``, ``.class``, ``#id``, ``[attr]``, ``[attr=v]``.

    Anything else raises ValueError.
    """

    _PART = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:=(?:\"(?P<q>[^\"]*)\"|'(?P<s>[^']*)'|(?P<v>[^\]\s]+)))?\]")

    def __init__(self, text: str) -> None:
        self.steps: list[list[tuple]] = []
        for word in text.split():
            at, tests = 0, []
            while at < len(word):
                m = self._PART.match(word, at)
                if not m:
                    raise ValueError(f"unsupported selector: {text}")
                g = m.groupdict()
                if g["tag"]:
                    tests.append(("tag", g["tag"].lower()))
                elif g["cls"]:
                    tests.append(("class", g["cls"]))
                elif g["id"]:
                    tests.append(("attr", "id", g["id"]))
                else:
                    tests.append(("attr", g["attr"].lower(), next((g[k] for k in "qsv" if g[k] is not None), None)))
                at = m.end()
            self.steps.append(tests)
        if not self.steps:
            raise ValueError("empty selector")

    @staticmethod
    def _fits(tree: Tree, e: int, tests: list[tuple]) -> bool:
        for t in tests:
            if t[0] == "tag":
                if t[1] not in ("*", tree.tag[e]):
                    return False
            elif t[0] == "class":
                if t[1] not in tree.classes(e):
                    return False
            elif t[1] not in tree.attrs[e] or (t[2] is not None and tree.attrs[e][t[1]] != t[2]):
                return False
        return True

    def first(self, tree: Tree) -> int | None:
        for e in range(1, len(tree.tag)):
            if not self._fits(tree, e, self.steps[-1]):
                continue
            rest, x = self.steps[:-1], tree.up[e]
            while rest and x > 0:
                if self._fits(tree, x, rest[-1]):
                    rest = rest[:-1]
                x = tree.up[x]
            if not rest:
                return e
        return None
