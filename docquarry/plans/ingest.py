"""From fetched pages to stored ones: parse, normalize, sanitize, localize, relink,
reconcile, prune, index.

The held pages of a source are a barrier: links can only be rewritten once all paths
are known. They meet the pages by source as one array of the targets a page really
links to, so no page sees the source's whole path list.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.ids import content_hash
from docquarry.functions.urls import page_path, page_path_of
from docquarry.model.ast import read_tree
from docquarry.model.transform import localize, relink
from docquarry.operators.index import Index, build_pages
from docquarry.operators.pages import map_rows, page_fields, parse_pages
from docquarry.operators.reconcile import CrawlOutcome, diff, prune_missing, upsert

PAGE_COLUMNS = ("source_id", "path", "title", "description", "body", "content_hash", "fetched_at", "ordinal")


def process(fetched: DataFrame, kinds: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Stored pages of fetched ones (source_id, url, html, fetched_at, ordinal).

    ``kinds`` (source_id, kind) names the sources' generators. The hash is that of the
    delivered html. Of pages with one path the one with the highest ordinal stays.
    ``manifest`` (source_id, url, name) names the stored copies of images, as
    :func:`docquarry.sources.store.assets` gives them; images without one, so all where
    there is no manifest, become placeholders.
    """
    rows = fetched.join(kinds.select("source_id", "kind"), "source_id", "left") if kinds is not None else fetched.withColumn("kind", F.lit(None).cast("string"))
    rows = rows.withColumn("path", page_path("url")).withColumn("content_hash", content_hash("html"))
    last = rows.groupBy("source_id", "path").agg(F.max("ordinal").alias("ordinal"))
    one = rows.join(last, ["source_id", "path", "ordinal"]).dropDuplicates(["source_id", "path"])
    keep = {"source_id": "string", "path": "string", "content_hash": "string", "fetched_at": "timestamp", "ordinal": "int", "url": "string"}
    parsed = parse_pages(one, keep, kind=F.col("kind"))
    targets = parsed.select("source_id", "path", F.explode("links").alias("link")).select("source_id", F.col("path").alias("src"), page_path("link").alias("path"))
    held = targets.join(parsed.select("source_id", "path"), ["source_id", "path"], "left_semi").groupBy("source_id", F.col("src").alias("path")).agg(F.collect_set(F.col("path")).alias("held"))
    local = parsed if manifest is None else localize_images(parsed, manifest)
    met = local.join(held, ["source_id", "path"], "left")
    none_held = manifest is None

    def make(body: str, url: str, paths: list[str] | None) -> list[tuple]:
        tree = read_tree(body)
        tree = localize(tree, {}) if none_held else tree
        return [(json.dumps(relink(tree, url, frozenset(paths or ()), page_path_of), ensure_ascii=False),)]

    out = {k: v for k, v in keep.items() if k != "url"} | {"title": "string", "description": "string"}
    return map_rows(met, out, {"body": F.col("body"), "url": F.col("url"), "held": F.col("held")}, {"body": "string"}, make).select(*PAGE_COLUMNS)


def _image_urls(body: str | None) -> list[tuple]:
    """Distinct addresses of a body's images."""
    tree, out, todo = read_tree(body), {}, []
    todo = [] if tree is None else [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if x.get("type") == "image" and isinstance(x.get("src"), str):
                out[x["src"]] = None
            todo += [v for v in x.values() if isinstance(v, (dict, list))]
        else:
            todo += [v for v in x if isinstance(v, (dict, list))]
    return [(u,) for u in out]


def localize_images(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages with their images replaced by stored copies. ``manifest``: source_id, url, name;
    of a url listed twice the least name counts. Only the images a page shows reach it, by
    a join on (source_id, url), so a source's manifest is never in one row."""
    shown = map_rows(pages, {"source_id": "string", "path": "string"}, {"body": F.col("body")}, {"url": "string"}, _image_urls).distinct()
    kept = manifest.where("name is not null").groupBy("source_id", "url").agg(F.min("name").alias("name"))
    own = shown.join(kept, ["source_id", "url"]).groupBy("source_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("url", "name"))).alias("held"))
    rest = [c for c in pages.columns if c != "body"]
    met = pages.join(own, ["source_id", "path"], "left").withColumn("held", F.to_json("held"))
    types = {c: pages.schema[c].dataType.simpleString() for c in rest}

    def make(body: str | None, held: str | None) -> list[tuple]:
        tree = read_tree(body)
        return [(body if tree is None else json.dumps(localize(tree, json.loads(held or "{}")), ensure_ascii=False),)]

    return map_rows(met, types, {"body": F.col("body"), "held": F.col("held")}, {"body": "string"}, make).select(*pages.columns)


@dataclass
class Pull:
    """What a pull leads to: the new catalogue, the changes, and the new index."""

    pages: DataFrame
    changes: DataFrame
    index: Index


def pull(old: DataFrame, fetched: DataFrame, outcome: CrawlOutcome, kinds: DataFrame | None = None, manifest: DataFrame | None = None) -> Pull:
    """Put a crawl's pages over the stored ones of the same source, prune if that is
    safe, and say what changed. ``old`` holds one source."""
    new = process(fetched, kinds, manifest)
    merged = upsert(old, new, ["source_id", "path"], ["ordinal"])
    kept = prune_missing(merged, new, outcome)
    return Pull(kept, diff(kept, old), index_of(kept))


def index_of(pages: DataFrame) -> Index:
    """The index of stored pages; unreadable bodies aren't in it."""
    stored = {c: "string" for c in ("source_id", "path", "title", "content_hash") if c in pages.columns}
    return build_pages(page_fields(pages, stored))


def sync_states(sources: DataFrame, trigger: str, now: Column) -> DataFrame:
    """(id, due) of every source."""
    from docquarry.operators.reconcile import sync_due

    return sources.select("id", sync_due(F.col("sync"), F.col("last_synced"), trigger, now).alias("due"))
