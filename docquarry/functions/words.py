"""Words of a string, as every text operator here counts them.

NFKC, U+00AD and U+200B deleted, lower case, maximal runs of letters and
numbers. ``[^\\W_]`` is the class ``[\\p{L}\\p{N}]`` of the interpreter's own
Unicode version.
"""

from __future__ import annotations

import re
import unicodedata

_RUNS = re.compile(r"[^\W_]+")
#: ASCII: letters to lower case, digits kept, all else to a space.
_ASCII = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def folded_form(text: str) -> str:
    """NFKC without U+00AD and U+200B."""
    return unicodedata.normalize("NFKC", text).replace("\u00ad", "").replace("\u200b", "")


def words(text: str | None) -> list[str]:
    """Words of ``text`` in order; none for null or empty text."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    folded = folded_form(text).lower()
    if folded.isascii():
        return folded.encode().translate(_ASCII).decode().split()
    return _RUNS.findall(folded)


def letters(text: str | None) -> str:
    """Only the letters of ``text``, NFKC, case folded."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return "".join(filter(str.isalpha, text.casefold()))
