"""Validity of identifiers and hashes, as column expressions. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SOURCE_TYPES = ("readthedocs", "rustdoc", "mdbook", "man", "generic", "local", "docset")
PLATFORMS = ("sphinx", "rustdoc", "mdbook", "gitbook", "docusaurus", "mkdocs", "generic")
SYMBOL_KINDS = ("function", "type", "trait", "module", "constant", "macro")
SOURCE_ID = "^[A-Za-z0-9][A-Za-z0-9._+-]{0,63}$"
CONTENT_HASH = "^[0-9a-f]{64}$"
PATH_BYTES = 2048


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def source_id_valid(c: Column | str) -> Column:
    """1 to 64 of ASCII letters, digits and ``.-_+``, the first a letter or digit."""
    return _col(c).rlike(SOURCE_ID) & ~_col(c).contains("\n")


def page_path_valid(c: Column | str) -> Column:
    """Relative, at most 2048 bytes, no NUL or backslash, no empty, ``.`` or ``..`` segment."""
    c = _col(c)
    return (F.octet_length(c) <= PATH_BYTES) & ~c.rlike(r"[\x00\\]") & ~c.rlike(r"(^|/)\.{0,2}(/|$)")


def content_hash_valid(c: Column | str) -> Column:
    return _col(c).rlike(CONTENT_HASH)


def content_hash(c: Column | str) -> Column:
    """Lower-case SHA-256 of a text's bytes."""
    return F.sha2(_col(c).cast("binary"), 256)


def clean_hash(c: Column | str) -> Column:
    """A hash in its one spelling: lower case, no ``sha256:`` in front."""
    return F.regexp_replace(F.lower(_col(c)), "^sha256:", "")


def clean_path(c: Column | str) -> Column:
    """A path without its leading slash."""
    return F.regexp_replace(_col(c), "^/", "")
