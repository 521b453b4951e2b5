"""Tree to tree: normalize, sanitize, localize images, relink.

All four are one bottom-up rewrite with a rule per node type. Their order matters
and is fixed by the ingest plan: normalize, sanitize, localize, relink. Fragments
are cleaned after they were made absolute, so ids and fragments stay matched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from urllib.parse import urldefrag

from docquarry.model.ast import CHILD_KEYS, text_content
from docquarry.model.parse import join_url, squeeze, text_node

# Fixed values.
LANGUAGE_ALIASES = {
    **dict.fromkeys(["rs"], "rust"),
    **dict.fromkeys(["py", "python3", "py3"], "python"),
    **dict.fromkeys(["js", "node", "nodejs"], "javascript"),
    **dict.fromkeys(["ts"], "typescript"),
    **dict.fromkeys(["sh", "shell", "console", "shell-session", "bash-session"], "bash"),
    **dict.fromkeys(["yml"], "yaml"),
    **dict.fromkeys(["md"], "markdown"),
    **dict.fromkeys(["c++", "cpp"], "cpp"),
    **dict.fromkeys(["c#", "cs"], "csharp"),
    **dict.fromkeys(["rb"], "ruby"),
    **dict.fromkeys(["text", "plain", "plaintext", "none"], "text"),
}
LINK_SCHEMES = frozenset(["http", "https", "mailto"])
IMAGE_SCHEMES = frozenset(["http", "https"])
DESCRIPTION_CHARS = 200

Rule = Callable[[dict], "dict | None"]


def rewrite(node: dict, rule: Rule, keep: Callable[[dict, dict], bool] = lambda owner, child: True, stop: frozenset = frozenset()) -> dict | None:
    """``node`` with ``rule`` applied to all nodes below, then to itself. ``keep`` says of
    each rewritten child whether its owner retains it; types in ``stop`` are left alone."""
    if node.get("type") in stop:
        return node
    new = dict(node)
    for k in CHILD_KEYS:
        if isinstance(node.get(k), list):
            made = (rewrite(x, rule, keep, stop) for x in node[k])
            new[k] = [x for x in made if x is not None and keep(node, x)]
    return rule(new) if "type" in new else new


def _walk(node: dict):
    yield node
    for k in CHILD_KEYS:
        for x in node.get(k) or ():
            yield from _walk(x)


def canonical_language(language: str | None) -> str | None:
    if language is None:
        return None
    low = language.strip().lower()
    return LANGUAGE_ALIASES.get(low, low)


def _worth_keeping(owner: dict, child: dict) -> bool:
    kind = child.get("type")
    if owner.get("type") == "link":
        return True
    if kind == "text":
        return child["value"] != ""
    return kind not in ("paragraph", "emphasis", "strong") or bool(child["children"])


def word_cut(text: str, limit: int = DESCRIPTION_CHARS) -> str:
    """``text`` up to the last word that ends within ``limit`` characters, with an ellipsis."""
    if len(text) <= limit:
        return text
    head = ""
    for w in text.split():
        if len(head) + len(w) + 1 > limit:
            break
        head = f"{head} {w}" if head else w
    return head + "…"


def normalize(body: dict, base: str) -> dict:
    """``{title, description, body}``: URLs absolute, languages canonical, empty nodes
    gone, headings shifted so that the highest is level 1."""

    def rule(n: dict) -> dict:
        if n["type"] == "link":
            n["href"] = join_url(base, n["href"]) or n["href"]
        elif n["type"] == "image":
            n["src"] = join_url(base, n["src"]) or n["src"]
        elif n["type"] == "code_block":
            n["language"] = canonical_language(n.get("language"))
        return n

    made = rewrite(body, rule, _worth_keeping)
    shift = min((n["level"] for n in _walk(made) if n.get("type") == "heading"), default=1) - 1
    if shift > 0:
        made = rewrite(made, lambda n: n | {"level": min(6, max(1, n["level"] - shift))} if n["type"] == "heading" else n, stop=frozenset(["table"]))
    title = next((t for n in made.get("children", ()) if n.get("type") == "heading" and n["level"] == 1 and (t := squeeze(text_content(n)))), None)
    first = next((t for n in _walk(made) if n.get("type") == "paragraph" and (t := squeeze(text_content(n)))), None)
    return {"title": title, "description": None if first is None else word_cut(first), "body": made}


_CONTROL_START = re.compile(r"^[\x00-\x20\x7f-\x9f]+")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")


def url_scheme(url: str) -> str | None:
    """The scheme a browser would see: tabs and line ends anywhere and leading controls don't count."""
    m = _SCHEME.match(_CONTROL_START.sub("", re.sub(r"[\t\n\r]", "", url)))
    return m[1].lower() if m else None


def clean_id(text: str) -> str:
    return "".join(c for c in text if not c.isspace() and unicodedata.category(c) != "Cc" and c not in "\"'`")


def clean_token(text: str | None) -> str:
    return re.sub("[^a-z0-9-]", "", (text or "").lower())


def sanitize(body: dict) -> dict:
    """Only allowed schemes, clean ids, fragments and class tokens; idempotent."""

    def rule(n: dict) -> dict:
        kind = n["type"]
        if kind == "link":
            if url_scheme(n["href"]) not in LINK_SCHEMES | {None}:
                return text_node(text_content(n))
            bare, mark, fragment = n["href"].partition("#")
            n["href"] = bare + mark + clean_id(fragment)
        elif kind == "image" and url_scheme(n["src"]) not in IMAGE_SCHEMES | {None}:
            return text_node(n["alt"] if n["alt"].strip() else "")
        elif kind == "heading" and n.get("id") is not None:
            n["id"] = clean_id(n["id"]) or None
        elif kind == "anchor":
            n["id"] = clean_id(n["id"])
        elif kind == "definition_list":
            n["items"] = [d | {"id": (clean_id(d["id"]) or None) if d.get("id") is not None else None} for d in n["items"]]
        elif kind == "admonition":
            n["kind"] = clean_token(n["kind"]) or "note"
        elif kind == "code_block":
            n["language"] = clean_token(n.get("language")) or None
        return n

    return rewrite(body, rule)


def localize(body: dict, manifest: dict[str, str]) -> dict:
    """Images by their stored copies (``manifest``: URL -> local name); a missing one
    becomes a placeholder; ``data:`` images pass."""

    def rule(n: dict) -> dict:
        if n["type"] != "image" or n["src"].startswith("data:"):
            return n
        held = manifest.get(n["src"])
        if held:
            return n | {"src": held}
        note = "image unavailable offline" + (f": {n['alt']}" if n["alt"] else "")
        return {"type": "emphasis", "children": [text_node(note)]}

    return rewrite(body, rule)


def relink(body: dict, base: str, held: set[str] | frozenset[str], path_of: Callable[[str], str | None]) -> dict:
    """Links to held pages become their local paths, with the fragment kept."""

    def rule(n: dict) -> dict:
        if n["type"] != "link" or n["href"].startswith("#"):
            return n
        target, fragment = urldefrag(join_url(base, n["href"]) or "")
        path = path_of(target) if target.startswith(("http:", "https:")) else None
        if path in held:
            n["href"] = path + (f"#{fragment}" if fragment else "")
        return n

    return rewrite(body, rule)
