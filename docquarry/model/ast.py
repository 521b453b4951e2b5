"""The page tree: reading its JSON and walking it in document order."""

from __future__ import annotations

import json
from typing import Any

#: Keys under which a node holds other nodes, in document order.
CHILD_KEYS = ("children", "items", "term", "definition", "headers", "rows", "cells")
_REVERSED = CHILD_KEYS[::-1]
#: Node type -> key of its text string.
TEXT_KEYS = {"text": "value", "code_block": "code", "inline_code": "code", "image": "alt"}
#: Times a value may have been encoded as a JSON string.
MAX_ENCODINGS = 4


def read_json(text: str | None) -> Any:
    """The value of a JSON text, unwrapped if it was encoded more than once.

    None where the text is null, empty, cut off or otherwise no JSON.
    """
    if not text:
        return None
    value: Any = text
    for _ in range(MAX_ENCODINGS):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
        if not isinstance(value, str):
            return value
    return None


def read_tree(text: str | None) -> dict | None:
    """The document object of a body, or None if the body is unreadable."""
    value = read_json(text)
    return value if isinstance(value, dict) else None


def as_list(value: Any) -> list:
    """A list; one object where a list is meant counts as a list of it."""
    return value if isinstance(value, list) else [] if value is None else [value]


def text_strings(root: Any) -> list[str]:
    """Text strings below ``root`` in document order, empty ones left out."""
    out: list[str] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if type(node) is dict:
            key = TEXT_KEYS.get(node.get("type"))
            if key:
                s = node.get(key)
                if s and type(s) is str:
                    out.append(s)
            for k in _REVERSED:
                v = node.get(k)
                if v:
                    stack.append(v)
        elif type(node) is list:
            stack.extend(reversed(node))
    return out


def text_content(root: Any) -> str:
    """All text strings of ``root`` joined with nothing between."""
    return "".join(text_strings(root))
