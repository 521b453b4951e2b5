"""Code as html: class-only spans, one ``line`` span per line.

Token classes come from pygments where it can be imported; unknown languages, very
long code and a missing pygments give plain escaped lines of the same structure.
"""

from __future__ import annotations

import html as htmllib

try:
    from pygments.lexers import get_lexer_by_name
    from pygments.token import STANDARD_TYPES
    from pygments.util import ClassNotFound
except ImportError:
    get_lexer_by_name = None

#: Code above this many bytes isn't coloured.
MOST_BYTES = 512 * 1024
#: Names pygments knows under another one.
ALIASES = {"csharp": "c#", "text": None, "": None}


def _class(kind) -> str:
    while kind is not None and kind not in STANDARD_TYPES:
        kind = kind.parent
    return STANDARD_TYPES.get(kind, "")


def tokens(code: str, language: str | None) -> list[tuple[str, str]]:
    """(class, text) pieces that join to ``code``; one piece without a class if plain."""
    name = ALIASES.get(language or "", language)
    if get_lexer_by_name is None or not name or len(code.encode()) > MOST_BYTES:
        return [("", code)]
    try:
        lexer = get_lexer_by_name(name, stripnl=False, ensurenl=False)
    except ClassNotFound:
        return [("", code)]
    found = [(_class(kind), text) for kind, text in lexer.get_tokens(code)]
    return found if "".join(t for _, t in found) == code else [("", code)]


def highlight(code: str, language: str | None = None) -> str:
    lines: list[list[str]] = [[]]
    for kind, text in tokens(code, language):
        for i, part in enumerate(text.split("\n")):
            if i:
                lines.append([])
            if part:
                safe = htmllib.escape(part)
                lines[-1].append(f'<span class="{kind}">{safe}</span>' if kind else safe)
    return "\n".join(f'<span class="line">{"".join(x)}</span>' for x in lines)
