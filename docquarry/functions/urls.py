"""URLs: parts, page paths, crawl scope, link classes. Column expressions, and their
Python twins where a tree walk needs them. Null in, null out."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.ids import page_path_valid

_SCHEME, _HOST, _PATH = r"^([A-Za-z][A-Za-z0-9+.-]*):", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), _SCHEME, 1))


def host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), _HOST, 1))


def url_path(c: Column | str) -> Column:
    """The path; ``/`` where the URL has none."""
    p = F.regexp_extract(_col(c), _PATH, 1)
    return F.when(p == "", "/").otherwise(p)


def page_path(c: Column | str) -> Column:
    """Where a page is kept: its path without the leading slash, ``index.html`` for
    a folder, and a name from the URL's hash where the path can't be one. The query
    and the fragment don't count."""
    bare = F.regexp_replace(url_path(c), "^/", "")
    full = F.when((bare == "") | bare.endswith("/"), F.concat(bare, F.lit("index.html"))).otherwise(bare)
    hashed = F.concat(F.lit("pages/"), F.substring(F.sha2(_col(c).cast("binary"), 256), 1, 16), F.lit(".html"))
    return F.when(page_path_valid(full), full).otherwise(hashed)


def page_url(origin: Column | str, path: Column | str) -> Column:
    """The URL a stored path came from, on its source's origin."""
    at = F.regexp_extract(_col(origin), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(at, F.lit("/"), F.regexp_replace(_col(path), r"(^|/)index\.html$", "$1"))


def registrable_domain(h: Column | str) -> Column:
    """The last two labels of a host name; an address stays whole."""
    h = F.lower(_col(h))
    address = h.rlike(r"^[0-9.]+$") | h.contains(":")
    return F.when(address, h).otherwise(F.regexp_extract(h, r"([^.]*\.)?[^.]*$", 0))


def scope(c: Column | str, entry: Column | str, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """in_scope, wrong_scheme, off_host, excluded or not_included, in that order of tests."""
    path = url_path(c)

    def hits(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | path.rlike(p)
        return out

    out = F.when(~scheme(c).isin("http", "https"), "wrong_scheme").when(registrable_domain(host(c)) != registrable_domain(host(entry)), "off_host").when(hits(exclude), "excluded")
    return (out.when(~hits(include), "not_included") if include else out).otherwise("in_scope")


def link_scheme(c: Column | str) -> Column:
    """The scheme a browser would see in a link, '' for none."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), r"[\t\n\r]", ""), r"^[\x00-\x20\x7f]+", "")
    return F.lower(F.regexp_extract(bare, _SCHEME, 1))


def link_class(c: Column | str) -> Column:
    """fragment, external or page."""
    return F.when(_col(c).startswith("#"), "fragment").when(_col(c).startswith("//") | (link_scheme(c) != ""), "external").otherwise("page")


def same_site_key(c: Column | str) -> Column:
    """URLs that differ by closing slashes only have one key."""
    return F.regexp_replace(_col(c), "/+$", "")


def source_id_from_url(c: Column | str) -> Column:
    """A source id for a URL: host labels without www, docs, doc and the top-level name,
    then path segments without a dot; other characters become ``-``; at most 64."""
    labels = F.split(host(c), r"\.")
    kept = F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(1))), lambda x: ~x.isin("www", "docs", "doc"))
    segments = F.filter(F.split(url_path(c), "/"), lambda x: (x != "") & ~x.contains("."))
    joined = F.lower(F.array_join(F.concat(kept, segments), "-"))
    return F.substring(F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9._+-]+", "-"), "^[^a-z0-9]+|-+$", ""), 1, 64)


_BAD_PATH = re.compile(r"[\x00\\]|(^|/)\.{0,2}(/|$)")


def page_path_of(url: str) -> str | None:
    """Python twin of :func:`page_path`; None for no URL."""
    try:
        path = urlsplit(url).path
    except ValueError:
        return None
    bare = path[1:] if path.startswith("/") else path
    full = bare + "index.html" if not bare or bare.endswith("/") else bare
    if len(full.encode()) <= 2048 and not _BAD_PATH.search(full):
        return full
    return f"pages/{hashlib.sha256(url.encode()).hexdigest()[:16]}.html"
