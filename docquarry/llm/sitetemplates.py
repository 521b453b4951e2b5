"""Main body of web pages, by removal of what a site's template repeats.

1. Every page is read into its elements once. Elements nobody reads as content
   are left out (hidden ones, scripts, buttons, navigation, furniture classes of
   the site's profile). What remains are text segments of innermost blocks, each
   with the hashes of the element subtrees it lies in.
2. A subtree is known by its content, never by its place alone. It is hashed with its
   tag, classes and text (a copy) and, where it has classes, with its text without
   digits (a template's wording around changing numbers). A classed subtree of more
   linked words than others is also hashed with what stands outside its links alone:
   the fixed heading over a list of links that is filled anew on every page. What an
   author writes under a class of the generator (a lead, a note, a listing) has
   content of its own and recurs nowhere. Hashes are counted over the distinct pages
   of a host.
3. Subtrees recurring across many pages of their host are deleted. A subtree that
   holds the page's title heading never is, however often it recurs.

A host's recurring hashes number at most (hashes per page) / MIN_SHARE, whatever
its number of pages, so they are one bounded array per host; counting combines
map-side and is spread by (host, hash), so a host with a third of all pages has
no task of its own.

Defined results: null or empty html has no line; a page without a title heading
keeps all that doesn't recur; a page fetched again at the same address counts
once for its host; pages without a host share one.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import cut, maybe_broadcast
from docquarry.sources.htmltree import VOID, Tree

#: Least pages (of classed wording, of a copy) and least share of a host's pages on which a subtree recurs.
MIN_WORDING_PAGES, MIN_COPY_PAGES, MIN_SHARE = 2, 3, 0.05

# Kinds of elements.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li pre th td dt dd".split())
CELLS = frozenset("td th dt dd".split())
UNREAD = frozenset("script style title textarea noscript template svg iframe head object select canvas".split())
FURNITURE = frozenset("nav aside header footer button form dialog menu".split())
INLINE = frozenset("a abbr b bdi bdo cite code dfn em font i kbd label mark q s samp small span strong sub sup time tt u var".split())
_READ = re.compile("class|hidden|style", re.I)
_VARIES = re.compile(r"[\d\s]+")
_CONCEALED = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _hash(*parts: str) -> int:
    return (xxhash.xxh3_64_intdigest("\x00".join(parts)) ^ (1 << 63)) - (1 << 63)


Segments = tuple[list[int], list[int], list[int], list[str], list[list[int]]]


def segments(text: str | None, drop_classes: frozenset) -> Segments:
    """Distinct subtree hashes of a page (a wording's is even, a copy's odd), and its text
    segments: blocks, their enclosing blocks or -1, texts, and the indexes of the hashes
    around them."""
    hashes: dict[int, int] = {}
    blocks, outers, texts, arounds = [], [], [], []
    if not text:
        return [], blocks, outers, texts, arounds
    page = Tree(text)
    tag, up, attrs, content = page.tag, page.up, page.attrs, page.content
    wraps = set()  # elements around a block
    whole = [""] * len(tag)  # texts of the subtrees
    plain = [""] * len(tag)  # those outside links
    for e in range(len(tag) - 1, 0, -1):
        if tag[e] in BLOCKS or e in wraps:
            wraps.add(up[e])
        whole[e] = "".join([x if isinstance(x, str) else whole[x] for x in content[e]]) + " "
        if tag[e] != "a" and tag[e] not in UNREAD:
            plain[e] = "".join([x if isinstance(x, str) else plain[x] for x in content[e]]) + " "
    kept_title = set()
    if "h1" in tag:
        e = tag.index("h1")
        while e >= 0:
            kept_title.add(e)
            e = up[e]
    outer_of: dict[int, int] = {}

    def add(block: int, piece: str, around: list[int]) -> None:
        if blocks and blocks[-1] == block and arounds[-1] is around:
            texts[-1] += piece
        else:
            blocks.append(block)
            outers.append(outer_of[block])
            texts.append(piece)
            arounds.append(around)

    todo: list[tuple] = [(0, -1, [])]
    while todo:
        x, block, around = todo.pop()
        if isinstance(x, str):
            if block >= 0:
                add(block, htmllib.unescape(x) if "&" in x else x, around)
            continue
        t = tag[x]
        if x:
            if t == "br":
                if block >= 0:
                    add(block, " ", around)
                continue
            if t in UNREAD or t in VOID:
                continue
            own = x in kept_title
            a = attrs.naming(x, _READ)
            if not own and (t in FURNITURE or (a and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or ("style" in a and _CONCEALED.search(a["style"]))))):
                continue
            classes = sorted(set(a["class"].lower().split())) if a.get("class") else []
            if classes and not own and not drop_classes.isdisjoint(classes):
                continue
            if not own and t not in INLINE:
                # a data cell that repeats is data, not template
                keys = [] if t in CELLS and x not in wraps else [_hash(t, *classes, " ".join(whole[x].split())) | 1]
                if classes and t not in CELLS:
                    wording = _VARIES.sub("", whole[x])
                    if wording:
                        keys.append(_hash(t, *classes, "", wording) & ~1)
                    fixed = _VARIES.sub("", plain[x])
                    if fixed and fixed != wording and 2 * len(plain[x].split()) < len(whole[x].split()):
                        keys.append(_hash(t, *classes, "links", fixed) & ~1)
                if keys:
                    around = around + [hashes.setdefault(k, len(hashes)) for k in keys]
            if t in BLOCKS:
                outer_of[x] = block
                block = x
        todo.extend([(c, block, around) for c in reversed(content[x])])
    return list(hashes), blocks, outers, texts, arounds


_COLUMNS = {"hashes": "array<long>", "blocks": "array<int>", "outers": "array<int>", "texts": "array<string>", "n_around": "array<int>", "around": "array<int>"}
_SHAPE = "id long, host string, address long, " + ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())


def _lists(parts: list[list], kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array([x for p in parts for x in p], kind))


def read_pages(df: DataFrame, id_col: str, host: str, address: str, html: str, classes: str | None) -> DataFrame:
    """One compact row per page: host, address hash, subtree hashes, text segments."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(host).cast("string").alias("host"), F.xxhash64(address).alias("address"), F.col(html).alias("html"), (F.col(classes) if classes else F.lit(None).cast("array<string>")).alias("classes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                got = [segments(h, frozenset(x.lower() for x in c or () if x)) for h, c in zip(b.column("html").to_pylist(), b.column("classes").to_pylist())]
                hashes, blocks, outers, texts, arounds = ([g[i] for g in got] for i in range(5))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c) for c in ("id", "host", "address")), _lists(hashes, pa.int64()), _lists(blocks, pa.int32()), _lists(outers, pa.int32()), _lists(texts, pa.string()),
                        _lists([[len(a) for a in x] for x in arounds], pa.int32()), _lists([[i for a in x for i in a] for x in arounds], pa.int32()),
                    ],
                    ["id", "host", "address", *_COLUMNS],
                )

    return rows.mapInArrow(run, _SHAPE)


def recurring(pages: DataFrame) -> DataFrame:
    """(host, template): the subtree hashes that recur across a host's pages, as an array."""
    host = F.coalesce("host", F.lit(""))
    total = pages.select(host.alias("host"), "address").distinct().groupBy("host").agg(F.count("*").alias("n"))
    seen = pages.select(host.alias("host"), "address", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count("*").alias("k"))
    least = F.when(F.col("hash") % 2 == 0, MIN_WORDING_PAGES).otherwise(MIN_COPY_PAGES)
    some = seen.where(F.col("k") >= least).join(total, "host").where(F.col("k") >= F.col("n") * MIN_SHARE)
    return some.groupBy("host").agg(F.collect_list("hash").alias("template"))


def kept_lines(blocks: list[int], outers: list[int], texts: list[str]) -> list[str]:
    """Distinct texts of the innermost blocks, of the segments that were kept."""
    parts: dict[int, list[str]] = {}
    outer = dict(zip(blocks, outers))
    for b, t in zip(blocks, texts):
        parts.setdefault(b, []).append(t)
    lines = {b: " ".join("".join(p).split()) for b, p in parts.items()}
    wraps = {outer[b] for b, line in lines.items() if line}  # blocks around another that has text
    todo = list(wraps)
    while todo:
        o = outer.get(todo.pop(), -1)
        if o >= 0 and o not in wraps:
            wraps.add(o)
            todo.append(o)
    return list(dict.fromkeys(line for b, line in lines.items() if line and b not in wraps))


def page_lines(b: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(row, kept lines) of pages with their host's template."""
    cols = {c: b.column(c) for c in _COLUMNS}
    off = {c: np.asarray(a.offsets) for c, a in cols.items()}
    flat = {c: a.values for c, a in cols.items()}
    hashes, around, n_around = (np.asarray(flat[c]) for c in ("hashes", "around", "n_around"))
    last, known = None, np.zeros(0, np.int64)
    for i in range(b.num_rows):
        host, t = b.column("__h")[i].as_py(), b.column("template")[i]
        if last is None or host != last[0]:
            last, known = (host,), np.sort(np.asarray(t.values)) if t.is_valid else np.zeros(0, np.int64)
        own = hashes[off["hashes"][i] : off["hashes"][i + 1]]
        gone = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own if len(known) else np.zeros(len(own), np.bool_)
        at = slice(off["blocks"][i], off["blocks"][i + 1])
        hit = np.concatenate([[0], np.cumsum(gone[around[off["around"][i] : off["around"][i + 1]]])])
        ends = np.cumsum(n_around[at])
        kept = np.flatnonzero(hit[ends] == hit[ends - n_around[at]])
        take = pa.array(kept + at.start)
        yield i, kept_lines(*(flat[c].take(take).to_pylist() for c in ("blocks", "outers", "texts")))


def main_lines(df: DataFrame, id_col: str, host: str, address: str, html: str, classes: str | None = None) -> DataFrame:
    """(id, main_line): the distinct lines of each page's main body."""
    pages = cut(read_pages(df, id_col, host, address, html, classes))
    template = cut(recurring(pages).withColumnRenamed("host", "__h"))
    met = pages.join(maybe_broadcast(template, 10_000), F.coalesce("host", F.lit("")) == F.col("__h"), "left").select("id", "__h", *_COLUMNS, "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lines = [], []
            for i, own in page_lines(b):
                at += [i] * len(own)
                lines += own
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int32())), pa.array(lines, pa.string())], ["id", "main_line"])

    return met.mapInArrow(run, "id long, main_line string")
