"""A page tree as HTML, as Markdown, as an outline, and in sections."""

from __future__ import annotations

import html as htmllib
import re

from docquarry.model.ast import text_content
from docquarry.model.highlight import highlight
from docquarry.model.parse import squeeze

OUTLINE_LEVELS = 4
MARKDOWN_BYTES = 48 * 1024
_ASSET = re.compile(r"assets/[A-Za-z0-9._-]+")
_EXTERNAL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")


def slugify(text: str) -> str:
    return re.sub(r"^-+|-+$", "", re.sub(r"[\s\x00-\x1f\x7f\"'`]+", "-", text.lower()))


class UniqueIds:
    """``x``, ``x-2``, ``x-3``...: never an id given before."""

    def __init__(self) -> None:
        self.used: set[str] = set()

    def take(self, wanted: str) -> str:
        name, n = wanted, 1
        while name in self.used:
            n += 1
            name = f"{wanted}-{n}"
        self.used.add(name)
        return name


def _attr(name: str, value: str | None) -> str:
    return "" if value is None else f' {name}="{htmllib.escape(value)}"'


class Html:
    """Renders nodes; every text and attribute is escaped."""

    TAGS = {"paragraph": "p", "blockquote": "blockquote", "emphasis": "em", "strong": "strong"}

    def __init__(self) -> None:
        self.ids = UniqueIds()

    def all(self, nodes: list[dict]) -> str:
        return "".join(map(self.node, nodes or ()))

    def cells(self, cells: list[dict], tag: str) -> str:
        return "<tr>" + "".join(f"<{tag}>{self.all(c['children'])}</{tag}>" for c in cells) + "</tr>"

    def node(self, n: dict) -> str:
        kind = n["type"]
        if kind in self.TAGS:
            return f"<{self.TAGS[kind]}>{self.all(n['children'])}</{self.TAGS[kind]}>"
        return getattr(self, "do_" + kind)(n)

    def do_document(self, n: dict) -> str:
        return f'<div class="page">{self.all(n["children"])}</div>'

    def do_heading(self, n: dict) -> str:
        wanted = n.get("id") or slugify(squeeze(text_content(n)))
        return f"<h{n['level']}{_attr('id', self.ids.take(wanted) if wanted else None)}>{self.all(n['children'])}</h{n['level']}>"

    def do_anchor(self, n: dict) -> str:
        return f"<a{_attr('id', self.ids.take(n['id']))}></a>" if n["id"] else ""

    def do_code_block(self, n: dict) -> str:
        return f"<pre><code{_attr('class', n.get('language') and 'language-' + n['language'])}>{highlight(n['code'], n.get('language'))}</code></pre>"

    def do_inline_code(self, n: dict) -> str:
        return f"<code>{htmllib.escape(n['code'])}</code>"

    def do_list(self, n: dict) -> str:
        tag = "ol" if n["ordered"] else "ul"
        start = _attr("start", str(n["start"])) if n["ordered"] and n.get("start") is not None else ""
        return f"<{tag}{start}>" + "".join(f"<li>{self.all(i['children'])}</li>" for i in n["items"]) + f"</{tag}>"

    def do_definition_list(self, n: dict) -> str:
        return "<dl>" + "".join(f"<dt{_attr('id', self.ids.take(d['id']) if d.get('id') else None)}>{self.all(d['term'])}</dt><dd>{self.all(d['definition'])}</dd>" for d in n["items"]) + "</dl>"

    def do_table(self, n: dict) -> str:
        head = f"<thead>{self.cells(n['headers'], 'th')}</thead>" if n["headers"] else ""
        return f"<table>{head}<tbody>{''.join(self.cells(r['cells'], 'td') for r in n['rows'])}</tbody></table>"

    def do_admonition(self, n: dict) -> str:
        title = f'<p class="title">{htmllib.escape(n["title"])}</p>' if n.get("title") else ""
        return f'<div{_attr("class", "admonition " + n["kind"])}>{title}{self.all(n["children"])}</div>'

    def do_image(self, n: dict) -> str:
        return f"<img{_attr('src', n['src'])}{_attr('alt', n['alt'])}>" if _ASSET.fullmatch(n["src"]) else htmllib.escape(n["alt"])

    def do_link(self, n: dict) -> str:
        rel = _attr("rel", "noopener noreferrer") if _EXTERNAL.match(n["href"]) else ""
        return f"<a{_attr('href', n['href'])}{_attr('title', n.get('title'))}{rel}>{self.all(n['children'])}</a>"

    def do_text(self, n: dict) -> str:
        return htmllib.escape(n["value"])

    def do_line_break(self, n: dict) -> str:
        return "<br>"

    def do_thematic_break(self, n: dict) -> str:
        return "<hr>"


def to_html(body: dict) -> str:
    return Html().node(body)


def inline_markdown(nodes: list[dict]) -> str:
    out = []
    for n in nodes or ():
        kind, inner = n["type"], n.get("children")
        out.append(
            n["value"] if kind == "text"
            else f"`{n['code']}`" if kind == "inline_code"
            else f"*{inline_markdown(inner)}*" if kind == "emphasis"
            else f"**{inline_markdown(inner)}**" if kind == "strong"
            else f"[{inline_markdown(inner)}]({n['href']})" if kind == "link"
            else f"[image: {n['alt']}]" if kind == "image"
            else f"{{#{n['id']}}}" if kind == "anchor"
            else "\n" if kind == "line_break"
            else text_content(n)
        )
    return "".join(out)


def _quoted(text: str) -> str:
    return "".join(f"> {line}\n" for line in text.rstrip().split("\n")) + "\n" if text.strip() else "\n"


def to_markdown(n: dict, depth: int = 0) -> str:
    """Markdown with heading ids, fences, lists, pipe tables and quotes."""

    def inner(nodes: list[dict], deeper: int = 0) -> str:
        return "".join(to_markdown(x, depth + deeper) for x in nodes or ())

    def row(cells: list[dict]) -> str:
        return "| " + " | ".join(inline_markdown(c["children"]).replace("|", "\\|").strip() for c in cells) + " |\n"

    kind = n["type"]
    if kind == "document":
        return inner(n["children"])
    if kind == "heading":
        return "\n" + "#" * min(6, max(1, n["level"])) + " " + inline_markdown(n["children"]) + (f" {{#{n['id']}}}" if n.get("id") is not None else "") + "\n\n"
    if kind == "paragraph":
        return inline_markdown(n["children"]) + "\n\n"
    if kind == "code_block":
        return f"```{n.get('language') or ''}\n{n['code']}" + ("" if n["code"].endswith("\n") else "\n") + "```\n\n"
    if kind == "blockquote":
        return _quoted(inner(n["children"]))
    if kind == "admonition":
        return f"> **{n['title'] if n.get('title') is not None else n['kind']}**\n" + _quoted(inner(n["children"]))
    if kind == "list":
        pad, out = "  " * depth, []
        for i, item in enumerate(n["items"]):
            mark = f"{(n['start'] if n.get('start') is not None else 1) + i}." if n["ordered"] else "-"
            first, *rest = inner(item["children"], 1).strip().split("\n")
            out += [f"{pad}{mark} {first}\n", *(f"{pad}  {line}\n" for line in rest)]
        return "".join(out) + "\n"
    if kind == "definition_list":
        return "".join(f"{inline_markdown(d['term'])}\n: {inner(d['definition']).strip()}\n\n" for d in n["items"])
    if kind == "table":
        head = row(n["headers"]) + "|" + " --- |" * len(n["headers"]) + "\n" if n["headers"] else ""
        return head + "".join(row(r["cells"]) for r in n["rows"]) + "\n"
    return "---\n\n" if kind == "thematic_break" else inline_markdown([n]) + "\n"


def cut_markdown(text: str, limit: int = MARKDOWN_BYTES) -> tuple[str, bool]:
    """The text up to ``limit`` bytes, ended at a paragraph, else a line; an open fence is closed."""
    raw = text.encode()
    if len(raw) <= limit:
        return text, False
    head = raw[:limit].decode(errors="ignore")
    at = max(head.rfind("\n\n"), -1)
    at = at if at > 0 else head.rfind("\n")
    head = head[:at] if at > 0 else head
    return head + ("\n```" if len(re.findall("^```", head, re.M)) % 2 else ""), True


def outline(body: dict) -> list[dict]:
    """Headings up to level 4: ``{ord, level, id, text, parent}``; the parent is the last
    heading before it of a smaller level, -1 for none."""
    out, open_at, ids = [], [], UniqueIds()
    todo = [body]
    while todo:
        n = todo.pop()
        if n.get("type") == "heading":
            text = squeeze(text_content(n))
            own = ids.take(n.get("id") or slugify(text) or "section")
            if n["level"] <= OUTLINE_LEVELS:
                while open_at and out[open_at[-1]]["level"] >= n["level"]:
                    open_at.pop()
                out.append({"ord": len(out), "level": n["level"], "id": own, "text": text, "parent": open_at[-1] if open_at else -1})
                open_at.append(len(out) - 1)
            continue
        for k in ("rows", "headers", "items", "children", "cells", "definition", "term"):
            todo.extend(reversed(n.get(k) or []))
    return out


def section(body: dict, wanted: str) -> list[dict]:
    """The top-level nodes from the heading or anchor with id ``wanted`` up to the next
    heading of the same or a higher level."""
    nodes = body["children"]
    for i, n in enumerate(nodes):
        if n.get("id") != wanted or n["type"] not in ("heading", "anchor"):
            continue
        start = i if n["type"] == "heading" else next((j for j in range(i + 1, len(nodes)) if nodes[j]["type"] == "heading"), i)
        if nodes[start]["type"] != "heading":
            return nodes[i:]
        end = next((j for j in range(start + 1, len(nodes)) if nodes[j]["type"] == "heading" and nodes[j]["level"] <= nodes[start]["level"]), len(nodes))
        return nodes[i:end]
    return []
