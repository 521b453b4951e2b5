"""What of a page tree is searched: headings, body and code; its symbols; its blocks."""

from __future__ import annotations

import re

from docquarry.model.ast import CHILD_KEYS

# Fixed values.
PATH_KINDS = {**dict.fromkeys("struct enum union primitive type".split(), "type"), **dict.fromkeys("fn method".split(), "function"), **dict.fromkeys("trait derive".split(), "trait"), "mod": "module", **dict.fromkeys("constant static".split(), "constant"), "macro": "macro"}
KEYWORD_KINDS = {
    **dict.fromkeys("fn def function func method async".split(), "function"),
    **dict.fromkeys("struct class enum union type interface record".split(), "type"),
    **dict.fromkeys("trait protocol".split(), "trait"),
    **dict.fromkeys("mod module package namespace".split(), "module"),
    **dict.fromkeys("const static constant var let".split(), "constant"),
    **dict.fromkeys("macro macro_rules".split(), "macro"),
}
MODIFIERS = frozenset("pub unsafe async const extern impl export default".split())
SIGNATURE_CHARS = 200
SNIPPET_CHARS, SNIPPET_LEAD, SNIPPET_LEAST = 240, 60, 32


def _below(node: dict) -> list[dict]:
    return [x for k in CHILD_KEYS for x in node.get(k) or ()]


def label(nodes: list[dict]) -> str:
    """Words of a heading or term: text and inline code through emphasis and links, spaced."""
    out: list[str] = []
    todo = list(reversed(nodes))
    while todo:
        n = todo.pop()
        kind = n.get("type")
        if kind == "text":
            out.append(n["value"])
        elif kind == "inline_code":
            out.append(n["code"])
        elif kind in ("emphasis", "strong", "link"):
            todo.extend(reversed(n["children"]))
    return " ".join(x for x in out if x).strip()


def search_fields(root: dict) -> dict:
    """``{headers, body, code}``: a heading's text is only a header, code only code."""
    headers, body, code = [], [], []
    todo = [root]
    while todo:
        n = todo.pop()
        kind = n.get("type")
        if kind == "heading":
            headers.append(label(n["children"]))
            continue
        if kind in ("code_block", "inline_code"):
            code.append(n["code"])
        elif kind == "text":
            body.append(n["value"])
        elif kind == "image":
            body.append(n["alt"])
        elif kind == "link":
            body.append(n.get("title"))
        elif kind == "admonition":
            body += [n["kind"], n.get("title")]
        todo.extend(reversed(_below(n)))
    return {"headers": [h for h in headers if h], "body": " ".join(x for x in body if x), "code": " ".join(x for x in code if x)}


_NAME = re.compile(r"(?:[^\W_]|[_.])+")


def identifier(word: str) -> str | None:
    """The name a word begins with: letters, digits, ``_`` and inner dots, not a number."""
    m = _NAME.match(word)
    name = m[0].strip(".") if m else ""
    return name if name and (name[0].isalpha() or name[0] == "_") else None


def symbol_of_path(path: str) -> tuple[str, str] | None:
    """(name, kind) of a file named ``kind.name.html``."""
    kind, dot, name = path.rpartition("/")[2].removesuffix(".html").partition(".")
    return (name, PATH_KINDS[kind]) if dot and name and "." not in name and kind in PATH_KINDS else None


def symbol_of_title(text: str) -> tuple[str, str] | None:
    """``Struct Vec``: a capitalised kind and a name; else as any declaration."""
    w = text.split()
    if len(text.strip()) <= SIGNATURE_CHARS and len(w) == 2 and w[0][0].isupper() and w[0].lower() in KEYWORD_KINDS and identifier(w[1]):
        return identifier(w[1]), KEYWORD_KINDS[w[0].lower()]
    return declaration(text)


def declaration(text: str) -> tuple[str, str] | None:
    """``pub const fn name``: modifiers, then kind words, then the name."""
    text = text.strip()
    if not text or len(text) > SIGNATURE_CHARS:
        return None
    kind = None
    for word in text.split():
        word = re.sub(r"^\W+|\W+$", "", word)
        if kind is None and word in MODIFIERS:
            kind = "constant" if word == "const" else None
        elif word in KEYWORD_KINDS:
            kind = KEYWORD_KINDS[word]
        else:
            name = identifier(word) if kind else None
            return (name, kind) if name else None
    return None


def symbol_of_heading(text: str) -> tuple[str, str] | None:
    """``name(args)`` is a function; else as any declaration."""
    head, paren, _ = text.strip().partition("(")
    if paren and len(text.strip()) <= SIGNATURE_CHARS and identifier(head) == head:
        return head, "function"
    return declaration(text)


def headings_and_terms(root: dict) -> list[str]:
    out: list[str] = []
    todo = [root]
    while todo:
        n = todo.pop()
        if n.get("type") == "heading":
            out.append(label(n["children"]))
            continue
        if "term" in n:
            out.append(label(n["term"] or []))
            todo.extend(reversed(n.get("definition") or []))
            continue
        todo.extend(reversed(_below(n)))
    return [x for x in out if x]


def symbols(path: str, title: str, root: dict) -> tuple[tuple[str, str] | None, list[tuple[str, str]]]:
    """The page's own symbol, and all it declares: by path, title, headings and terms,
    the first of names that differ by case only."""
    by_path, by_title = symbol_of_path(path), symbol_of_title(title)
    found: dict[str, tuple[str, str]] = {}
    for s in [by_path, by_title, *map(symbol_of_heading, headings_and_terms(root))]:
        if s:
            found.setdefault(s[0].lower(), s)
    return by_path or by_title, list(found.values())


def _inline(nodes: list[dict]) -> str:
    out: list[str] = []
    todo = list(reversed(nodes))
    while todo:
        n = todo.pop()
        kind = n.get("type")
        if kind == "text":
            out.append(n["value"])
        elif kind == "inline_code":
            out.append(n["code"])
        elif kind == "line_break":
            out.append(" ")
        elif kind in ("emphasis", "strong", "link"):
            todo.extend(reversed(n["children"]))
    return " ".join("".join(out).split())


def blocks(node: dict) -> list[str]:
    """The texts a snippet may show, in document order."""
    kind = node.get("type")
    if kind in ("paragraph", "heading", "blockquote"):
        own = [_inline(node["children"])]
    elif kind == "code_block":
        own = [node["code"].strip()]
    elif kind == "definition_list":
        own = []
        for d in node["items"]:
            inner = [b for x in d["definition"] for b in blocks(x)]
            own += [" — ".join(x for x in (_inline(d["term"]), inner[0] if inner else "") if x), *inner[1:]]
    else:
        own = [node["title"]] if kind == "admonition" and node.get("title") else []
        if kind in ("document", "list", "table", "admonition", None):
            own += [b for x in _below(node) for b in blocks(x)]
    return [b for b in own if b]


def match_spans(text: str, terms: list[str]) -> list[tuple[int, int]]:
    """Where whole terms stand in a text, case ignored, overlapping ones merged."""
    low = text.lower()
    low = low if len(low) == len(text) else text
    found = sorted(m.span() for t in terms if t for m in re.finditer(rf"(?<!\w)(?={re.escape(t)}(?!\w))", low) for m in [re.compile(re.escape(t)).match(low, m.start())])
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _in_word(text: str, i: int) -> bool:
    return 0 < i < len(text) and all(c.isalnum() or c == "_" for c in text[i - 1 : i + 1])


def snippet(root: dict, terms: list[str], limit: int = SNIPPET_CHARS) -> list[tuple[str, bool]]:
    """(text, matched) pieces of the block with most distinct terms, the earliest of equals."""
    limit, all_blocks = max(limit, SNIPPET_LEAST), blocks(root)
    if not all_blocks:
        return []
    text = max(all_blocks, key=lambda b: sum(bool(match_spans(b, [t])) for t in terms))
    spans = match_spans(text, terms)
    start = max(0, (spans[0][0] if spans else 0) - SNIPPET_LEAD)
    end = min(len(text), start + limit)
    while _in_word(text, start):
        start -= 1
    while _in_word(text, end):
        end += 1
    pieces, at = [("…", False)] if start else [], start
    for a, b in spans:
        if b > start and a < end:
            a, b = max(a, start), min(b, end)
            pieces += [(text[at:a], False), (text[a:b], True)]
            at = b
    pieces += [(text[at:end], False), ("…" if end < len(text) else "", False)]
    out: list[tuple[str, bool]] = []
    for piece, hit in pieces:
        if piece and out and out[-1][1] == hit:
            out[-1] = (out[-1][0] + piece, hit)
        elif piece:
            out.append((piece, hit))
    return out
