"""Page operators: one Arrow pass per page, no shuffle.

Trees don't fit a fixed Spark type, so parsing, rewriting and rendering run in
Arrow batches next to the scan; everything relational stays in DataFrames.
Null or unreadable bodies and null html are defined at each operator.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.model import fields, render
from docquarry.model.ast import read_tree
from docquarry.model.parse import parse_page
from docquarry.model.profiles import DROP_CLASSES
from docquarry.model.transform import normalize, sanitize

_PA = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def map_rows(df: DataFrame, keep: dict[str, str], inputs: dict[str, Column], output: dict[str, str], make: Callable[..., list[tuple]]) -> DataFrame:
    """For each row the tuples ``make(*inputs)`` returns, with the ``keep`` columns before
    them. Other columns of ``df`` aren't read, so their names can't clash."""
    names, ins, outs = list(keep), [f"__{k}" for k in inputs], list(output)
    schema = ", ".join(f"`{k}` {v}" for k, v in (keep | output).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            made: list[tuple] = []
            for i, args in enumerate(zip(*(b.column(c).to_pylist() for c in ins))):
                rows = make(*args)
                at += [i] * len(rows)
                made += rows
            take = pa.array(at, pa.int32())
            cols = list(zip(*made)) if made else [()] * len(outs)
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in names], *[pa.array(list(c), _PA[output[k]]) for k, c in zip(outs, cols)]], [*names, *outs])

    return df.select(*[F.col(k).cast(v) for k, v in keep.items()], *[c.alias(n) for n, c in zip(ins, inputs.values())]).mapInArrow(run, schema)


def parse_pages(df: DataFrame, keep: dict[str, str], html: str = "html", url: str = "url", kind: Column | None = None, selector: str | None = None) -> DataFrame:
    """title, description, body (JSON) and links of fetched pages, parsed, normalized and
    sanitized. Null html gives an empty document and no title."""

    def make(h: str | None, u: str | None, k: str | None) -> list[tuple]:
        parsed = parse_page(h, u or "", selector, DROP_CLASSES.get(k or "", frozenset()))
        page = normalize(parsed["body"], u or "")
        return [(page["title"] or parsed["title"], page["description"], json.dumps(sanitize(page["body"]), ensure_ascii=False), parsed["links"])]

    return map_rows(df, keep, {"html": F.col(html), "url": F.col(url), "kind": kind if kind is not None else F.lit(None).cast("string")}, {"title": "string", "description": "string", "body": "string", "links": "array<string>"}, make)


def page_fields(df: DataFrame, keep: dict[str, str], body: str = "body", path: str = "path", title: str = "title") -> DataFrame:
    """headers, body_text, code, symbol, symbol_kind and declarations of readable pages."""

    def make(text: str | None, p: str | None, t: str | None) -> list[tuple]:
        tree = read_tree(text)
        if tree is None:
            return []
        f = fields.search_fields(tree)
        own, every = fields.symbols(p or "", t or "", tree)
        return [(f["headers"], f["body"], f["code"], own and own[0], own and own[1], [s[0] for s in every])]

    return map_rows(df, keep, {"text": F.col(body), "path": F.col(path), "title": F.col(title)}, {"headers": "array<string>", "body_text": "string", "code": "string", "symbol": "string", "symbol_kind": "string", "declarations": "array<string>"}, make)


def page_symbols(df: DataFrame, keep: dict[str, str], body: str = "body", path: str = "path", title: str = "title") -> DataFrame:
    """One row per declared symbol: ord, name, kind."""

    def make(text: str | None, p: str | None, t: str | None) -> list[tuple]:
        tree = read_tree(text)
        return [] if tree is None else [(i, n, k) for i, (n, k) in enumerate(fields.symbols(p or "", t or "", tree)[1])]

    return map_rows(df, keep, {"text": F.col(body), "path": F.col(path), "title": F.col(title)}, {"ord": "int", "name": "string", "kind": "string"}, make)


def page_blocks(df: DataFrame, keep: dict[str, str], body: str = "body") -> DataFrame:
    """One row per snippet block of a readable page: ord, text."""
    return map_rows(df, keep, {"text": F.col(body)}, {"ord": "int", "text": "string"}, lambda text: [] if (t := read_tree(text)) is None else list(enumerate(fields.blocks(t))))


def page_outline(df: DataFrame, keep: dict[str, str], body: str = "body") -> DataFrame:
    """One row per heading up to level 4: ord, level, id, text, parent."""

    def make(text: str | None) -> list[tuple]:
        tree = read_tree(text)
        return [] if tree is None else [(h["ord"], h["level"], h["id"], h["text"], h["parent"]) for h in render.outline(tree)]

    return map_rows(df, keep, {"text": F.col(body)}, {"ord": "int", "level": "int", "id": "string", "text": "string", "parent": "int"}, make)


def page_markdown(df: DataFrame, keep: dict[str, str], body: str = "body", limit: int | None = None) -> DataFrame:
    """markdown of readable pages, whole unless a ``limit`` in bytes is given, and whether it was cut."""

    def make(text: str | None) -> list[tuple]:
        tree = read_tree(text)
        if tree is None:
            return []
        whole = render.to_markdown(tree)
        return [(whole, False) if limit is None else render.cut_markdown(whole, limit)]

    return map_rows(df, keep, {"text": F.col(body)}, {"markdown": "string", "truncated": "boolean"}, make)


def page_markdown_cut(df: DataFrame, keep: dict[str, str], body: str = "body", limit: int = render.MARKDOWN_BYTES) -> DataFrame:
    """As page_markdown, cut at ``limit`` bytes for a surface of bounded size."""
    return page_markdown(df, keep, body, limit)


def page_html(df: DataFrame, keep: dict[str, str], body: str = "body") -> DataFrame:
    """Safe html of readable pages."""
    return map_rows(df, keep, {"text": F.col(body)}, {"html": "string"}, lambda text: [] if (t := read_tree(text)) is None else [(render.to_html(sanitize(t)),)])


def page_sections(df: DataFrame, keep: dict[str, str], body: str = "body") -> DataFrame:
    """Markdown of each section of a readable page: section id, markdown."""

    def make(text: str | None) -> list[tuple]:
        tree = read_tree(text)
        ids = list(dict.fromkeys(n["id"] for n in (tree or {}).get("children") or [] if n.get("type") in ("heading", "anchor") and n.get("id")))
        return [(i, "".join(map(render.to_markdown, render.section(tree, i))).strip()) for i in ids]

    return map_rows(df, keep, {"text": F.col(body)}, {"section_id": "string", "markdown": "string"}, make)


def snippets(df: DataFrame, keep: dict[str, str], terms: str, body: str = "body", limit: int = fields.SNIPPET_CHARS) -> DataFrame:
    """The pieces of a page's snippet for an array column of terms: ord, text, matched. No
    row for a page that is missing or unreadable."""

    def make(text: str | None, words: list[str] | None) -> list[tuple]:
        tree = read_tree(text)
        return [] if tree is None else [(i, t, m) for i, (t, m) in enumerate(fields.snippet(tree, words or [], limit))]

    return map_rows(df, keep, {"text": F.col(body), "terms": F.col(terms)}, {"ord": "int", "text": "string", "matched": "boolean"}, make)


def find_in_page(df: DataFrame, keep: dict[str, str], needle: str, body: str = "body") -> DataFrame:
    """Every place of a text in a page, case ignored, across elements and overlapping: ord, pos."""
    from docquarry.model.ast import text_content

    low = needle.lower()

    def make(text: str | None) -> list[tuple]:
        tree = read_tree(text)
        hay = text_content(tree).lower() if tree is not None and low else ""
        out, at = [], hay.find(low)
        while low and at >= 0:
            out.append((len(out), at))
            at = hay.find(low, at + 1)
        return out

    return map_rows(df, keep, {"text": F.col(body)}, {"ord": "int", "pos": "int"}, make)
