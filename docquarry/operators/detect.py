"""Which site generator made a page: ordered rules over its lower-case html."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (platform, confidence, marks), the first rule with a mark in the page wins.
RULES: tuple[tuple[str, float, tuple[str, ...]], ...] = (
    ("mdbook", 0.95, ("sidebar-scrollbox",)),
    ("rustdoc", 0.97, ("/rustdoc-", "normalize-", "rustdoc-vars", "data-rustdoc")),
    ("mdbook", 0.95, ("sidebar-scrollbox", "mdbook.js", "book.js", "mdbook-")),
    ("sphinx", 0.95, ("documentation_options.js", "searchtools.js", "sphinxsidebar", "sphinx-highlight.js", "_static/pygments.css")),
    ("docusaurus", 0.95, ("__docusaurus", "docusaurus_skiptocontent", "docusaurus-mt-")),
    ("mkdocs", 0.9, ("md-component", "md-header", "md-nav__", "md-typeset")),
    ("gitbook", 0.9, ("gitbook-root", "__gitbook", "gitbook.com/", "gitbook-plugin")),
    ("mkdocs", 0.85, ('built with <a href="https://www.mkdocs.org', "mkdocs-", "/mkdocs/")),
    ("sphinx", 0.85, ("_static/", "sphinx")),
)
FALLBACK = ("generic", 0.4)
CONFIDENT = 0.8
TYPE_OF_PLATFORM = {"sphinx": "readthedocs", "rustdoc": "rustdoc", "mdbook": "mdbook"}


def _first_rule(html: Column, pick: int) -> Column:
    low, out = F.lower(html), None
    for rule in RULES:
        hit = F.lit(False)
        for mark in rule[2]:
            hit = hit | low.contains(mark)
        out = F.when(hit, F.lit(rule[pick])) if out is None else out.when(hit, F.lit(rule[pick]))
    return out.otherwise(F.lit(FALLBACK[pick]))


def platform(html: Column) -> Column:
    """The platform's name; null html is generic."""
    return _first_rule(F.coalesce(html, F.lit("")), 0)


def confidence(html: Column) -> Column:
    return _first_rule(F.coalesce(html, F.lit("")), 1)


def source_type(html: Column) -> Column:
    """The source type to configure: the platform's if it is certain enough, else generic."""
    p, out = platform(html), None
    for name, kind in TYPE_OF_PLATFORM.items():
        hit = (p == name) & (confidence(html) >= CONFIDENT)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("generic")


def detect_pages(df: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``keep``, platform, confidence, source_type and whether it is certain enough."""
    h = F.col(html)
    return df.select(*keep, platform(h).alias("platform"), confidence(h).alias("confidence"), source_type(h).alias("source_type"), (confidence(h) >= CONFIDENT).alias("confident"))
