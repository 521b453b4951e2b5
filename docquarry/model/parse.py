"""Web page to page tree: title, body, links.

Elements without a node of their own are opened in place by a stack, so wrappers may lie
in each other to any depth. Nodes are nested up to MOST_DEPTH; elements below that are
opened too: their text stays, their own markup doesn't.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Callable
from urllib.parse import urldefrag, urljoin, urlsplit

from docquarry.model.ast import text_content
from docquarry.sources.htmltree import Selector, Tree

# Fixed values.
CONTENT_ROOTS = ("main", "[role=main]", "article", "body")
DROPPED = frozenset("script style noscript template nav aside header footer form iframe object embed select button svg canvas dialog".split())
CHROME_FRAGMENTS = tuple("breadcrumb hideme screen-reader sr-only visually-hidden assistive-text code-toolbar pre-footer page-meta feedback".split())
PERMALINK_MARKS = frozenset(["¶", "§", "#", "🔗", "⚓", "↩", "↵", "&para;"])
ADMONITIONS = tuple("note warning tip important caution danger attention hint error seealso".split())
LANGUAGE_PREFIXES = ("language-", "lang-", "highlight-")
#: Nodes of a page that may lie in each other.
MOST_DEPTH = 100
INLINE_TYPES = frozenset("text emphasis strong inline_code link image".split())

_ROOTS = [Selector(s) for s in CONTENT_ROOTS]
_CHROME = re.compile("|".join(map(re.escape, CHROME_FRAGMENTS)))


def squeeze(text: str) -> str:
    """White space collapsed and trimmed."""
    return " ".join(text.split())


def join_url(base: str, href: str) -> str | None:
    """``href`` resolved against ``base``; None if that is no URL."""
    try:
        url = urljoin(base, href.strip())
        parts = urlsplit(url)
        parts.port  # noqa: B018 - raises on a malformed port
    except ValueError:
        return None
    if parts.scheme in ("http", "https"):
        if not parts.hostname:
            return None
        url = parts._replace(netloc=parts.netloc.lower() if "@" not in parts.netloc else parts.netloc, path=parts.path or "/").geturl()
    return url if parts.scheme else None


def text_node(value: str) -> dict:
    return {"type": "text", "value": value}


def tidy(nodes: list[dict]) -> list[dict]:
    """A block's children: adjacent text merged, ends trimmed, and white space alone
    kept only between two nodes that carry words."""
    merged: list[dict] = []
    for n in nodes:
        if n["type"] == "text" and merged and merged[-1]["type"] == "text":
            merged[-1] = text_node(re.sub(" {2,}", " ", merged[-1]["value"] + n["value"]))
        else:
            merged.append(n)
    for i, cut in ((0, str.lstrip), (-1, str.rstrip)):
        if merged and merged[i]["type"] == "text":
            merged[i] = text_node(cut(merged[i]["value"]))

    def stays(i: int) -> bool:
        n = merged[i]
        if n["type"] != "text" or n["value"].strip():
            return True
        return bool(n["value"]) and 0 < i < len(merged) - 1 and merged[i - 1]["type"] in INLINE_TYPES and merged[i + 1]["type"] in INLINE_TYPES

    return [n for i, n in enumerate(merged) if stays(i)]


class Reader:
    """Turns the elements of one page into nodes."""

    def __init__(self, tree: Tree, drop_classes: frozenset[str]) -> None:
        self.tree, self.drop_classes, self.depth = tree, drop_classes, 0

    def dropped(self, e: int) -> bool:
        a = self.tree.attrs[e]
        if self.tree.tag[e] in DROPPED or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
            return True
        names = a.get("class", "")
        if self.drop_classes and any(c.lower() in self.drop_classes for c in names.split()):
            return True
        return bool(names or "id" in a) and _CHROME.search(f"{names} {a.get('id', '')}".lower()) is not None

    def content_text(self, e: int) -> str:
        """Text of a subtree without its dropped parts."""
        out, todo = [], self.tree.content[e][::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(htmllib.unescape(x))
            elif not self.dropped(x):
                todo += self.tree.content[x][::-1]
        return "".join(out)

    def opened(self, e: int) -> bool:
        """Whether an element's content stands in its place."""
        tag = self.tree.tag[e]
        if tag in ("div", "section"):
            return self.depth >= MOST_DEPTH or "admonition" not in self.tree.classes(e)
        if tag == "span":
            return "id" not in self.tree.attrs[e] or bool(self.tree.text(e))
        return tag not in _MAKERS or (self.depth >= MOST_DEPTH and tag not in _LEAVES)

    def nodes(self, e: int) -> list[dict]:
        out: list[dict] = []
        todo = self.tree.content[e][::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out += self.text(x)
            elif not self.dropped(x):
                if self.opened(x):
                    own = self.tree.attrs[x].get("id")
                    if own is not None:
                        out.append({"type": "anchor", "id": own})
                    todo += self.tree.content[x][::-1]
                else:
                    out += self.element(x)
        return out

    def block(self, e: int) -> list[dict]:
        return tidy(self.nodes(e))

    @staticmethod
    def text(raw: str) -> list[dict]:
        s = htmllib.unescape(raw)
        core = squeeze(s)
        if not core:
            return [text_node(" ")] if s else []
        return [text_node(" " * s[0].isspace() + core + " " * s[-1].isspace())]

    def titled(self, e: int) -> list[dict]:
        """Children of a heading or term, without permalinks."""

        def permalink(n: dict) -> bool:
            if n["type"] == "text":
                return n["value"] == "¶"
            inner = n.get("children") or []
            return n["type"] == "link" and n["href"].startswith("#") and len(inner) == 1 and inner[0]["type"] == "text" and inner[0]["value"].strip() in PERMALINK_MARKS

        kept = tidy([n for n in self.nodes(e) if not permalink(n)])
        if len(kept) == 1 and kept[0]["type"] == "link" and kept[0]["href"].startswith("#"):
            return kept[0]["children"]
        return kept

    def language(self, e: int) -> str | None:
        for c in self.tree.classes(e):
            for p in LANGUAGE_PREFIXES:
                if c.startswith(p) and c[len(p) :] not in ("", "default"):
                    return c[len(p) :]
        return None

    def element(self, e: int) -> list[dict]:
        make = _MAKERS.get(self.tree.tag[e])
        if make is None or self.opened(e):
            return self.unwrap(e)
        self.depth += 1
        try:
            return make(self, e)
        finally:
            self.depth -= 1

    def unwrap(self, e: int) -> list[dict]:
        own = self.tree.attrs[e].get("id")
        return ([{"type": "anchor", "id": own}] if own is not None else []) + self.nodes(e)

    def heading(self, e: int) -> list[dict]:
        return [{"type": "heading", "level": int(self.tree.tag[e][1]), "id": self.tree.attrs[e].get("id"), "children": self.titled(e)}]

    def pre(self, e: int) -> list[dict]:
        tree = self.tree
        code = next((x for x in tree.below(e) if tree.tag[x] == "code"), None)
        around = [e]
        while tree.up[around[-1]] > 0:
            around.append(tree.up[around[-1]])
        tried = ([code] if code is not None else []) + around
        language = next((x for x in map(self.language, tried) if x), None)
        text = tree.text(code) if code is not None else self.content_text(e)
        return [{"type": "code_block", "language": language, "code": text.rstrip()}]

    def link(self, e: int) -> list[dict]:
        a = self.tree.attrs[e]
        anchor = [{"type": "anchor", "id": a["id"]}] if "id" in a else []
        if "href" not in a:
            return anchor or self.nodes(e)
        if a["href"].startswith("#") and self.tree.text(e).strip() in PERMALINK_MARKS:
            return anchor
        return [{"type": "link", "href": a["href"], "title": a.get("title"), "children": self.nodes(e)}]

    def list(self, e: int) -> list[dict]:
        start = self.tree.attrs[e].get("start", "")
        items = [{"children": self.block(x)} for x in self.tree.elements(e) if self.tree.tag[x] == "li"]
        return [{"type": "list", "ordered": self.tree.tag[e] == "ol", "start": int(start) if re.fullmatch(r"\+?\d{1,9}", start) else None, "items": items}]

    def definitions(self, e: int) -> list[dict]:
        items: list[dict] = []
        for x in self.tree.elements(e):
            if self.tree.tag[x] == "dt":
                items.append({"id": self.tree.attrs[x].get("id"), "term": self.titled(x), "definition": []})
            elif self.tree.tag[x] == "dd":
                body = self.block(x)
                if items and not items[-1]["definition"]:
                    items[-1]["definition"] = body
                else:
                    items.append({"id": None, "term": [], "definition": body})
        return [{"type": "definition_list", "items": items}]

    def own_rows(self, e: int) -> list[int]:
        """The rows of a table, without those of tables inside it, which their cells hold."""
        out, todo = [], self.tree.elements(e)[::-1]
        while todo:
            x = todo.pop()
            if self.tree.tag[x] == "tr":
                out.append(x)
            elif self.tree.tag[x] != "table":
                todo += self.tree.elements(x)[::-1]
        return out

    def table(self, e: int) -> list[dict]:
        headers: list[dict] = []
        rows: list[dict] = []
        for tr in self.own_rows(e):
            own = self.tree.elements(tr)
            cells = [{"children": self.block(x)} for x in own if self.tree.tag[x] in ("td", "th")]
            if cells and not headers and not rows and all(self.tree.tag[x] != "td" for x in own):
                headers = cells
            else:
                rows.append({"cells": cells})
        return [{"type": "table", "headers": headers, "rows": rows}]

    def box(self, e: int) -> list[dict]:
        """A div or section: an admonition, or nothing of its own."""
        names = self.tree.classes(e)
        if "admonition" not in names:
            return self.unwrap(e)
        title, inner = None, []
        for x in self.tree.content[e]:
            if isinstance(x, str):
                inner += self.text(x)
            elif "admonition-title" in self.tree.classes(x):
                title = squeeze(self.tree.text(x)) or title
            elif not self.dropped(x):
                inner += self.element(x)
        return [{"type": "admonition", "kind": next((c for c in names if c in ADMONITIONS), "note"), "title": title, "children": tidy(inner)}]

    def span(self, e: int) -> list[dict]:
        own = self.tree.attrs[e].get("id")
        return [{"type": "anchor", "id": own}] if own is not None and not self.tree.text(e) else self.unwrap(e)

    def image(self, e: int) -> list[dict]:
        a = self.tree.attrs[e]
        return [{"type": "image", "src": a["src"], "alt": a.get("alt", "")}] if "src" in a else []


def _wrap(kind: str, block: bool = False) -> Callable:
    return lambda r, e: [{"type": kind, "children": r.block(e) if block else r.nodes(e)}]


_MAKERS: dict[str, Callable[[Reader, int], list[dict]]] = {
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), Reader.heading),
    **dict.fromkeys(("code", "kbd", "samp"), lambda r, e: [{"type": "inline_code", "code": r.tree.text(e)}]),
    **dict.fromkeys(("em", "i", "cite", "var", "dfn"), _wrap("emphasis")),
    **dict.fromkeys(("strong", "b"), _wrap("strong")),
    **dict.fromkeys(("ul", "ol"), Reader.list),
    **dict.fromkeys(("div", "section"), Reader.box),
    "p": _wrap("paragraph", True),
    "blockquote": _wrap("blockquote", True),
    "pre": Reader.pre,
    "a": Reader.link,
    "dl": Reader.definitions,
    "table": Reader.table,
    "img": Reader.image,
    "span": Reader.span,
    "hr": lambda r, e: [{"type": "thematic_break"}],
    "br": lambda r, e: [{"type": "line_break"}],
}


#: Elements whose nodes hold no others.
_LEAVES = frozenset(["code", "kbd", "samp", "pre", "img", "hr", "br"])


def content_root(tree: Tree, selector: str | None = None) -> int | None:
    """The configured selector's first match, else the first of the usual roots."""
    tried = list(_ROOTS)
    if selector:
        try:
            tried.insert(0, Selector(selector))
        except ValueError:
            pass
    return next((e for s in tried if (e := s.first(tree)) is not None), 0)


def page_links(tree: Tree, base: str) -> list[str]:
    """Distinct http(s) targets of the whole page in order, without fragments."""
    found = (join_url(base, tree.attrs[e]["href"]) for e in range(1, len(tree.tag)) if tree.tag[e] == "a" and "href" in tree.attrs[e])
    return list(dict.fromkeys(urldefrag(u)[0] for u in found if u and u.startswith(("http:", "https:"))))


def parse_page(html: str | None, base: str, selector: str | None = None, drop_classes: frozenset[str] = frozenset()) -> dict:
    """``{title, body, links}`` of a page; an empty document for null or empty html."""
    tree = Tree(html or "")
    root = content_root(tree, selector)
    children = Reader(tree, drop_classes).block(root) if root is not None else []
    title = next((t for e in range(1, len(tree.tag)) if tree.tag[e] == "title" and (t := squeeze(tree.text(e)))), None)
    if title is None:
        title = next((t for n in children if n["type"] == "heading" and n["level"] == 1 and (t := squeeze(text_content(n)))), None)
    return {"title": title, "body": {"type": "document", "children": children}, "links": page_links(tree, base)}
