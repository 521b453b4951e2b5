"""Registered queries of the core library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.flatten import NODE_FIELDS, TOC_FIELDS, flatten_json
from docquarry.operators.keychunks import key_stats, number_rows
from docquarry.operators.snapshots import snapshot_changes
from docquarry.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if it has one."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Nested records ------------------------------------------------------------


_OBJECTS_SQL = """
    with once as (select page_id, case when json_type(body) = 'VARCHAR' then json_extract_string(body, '$') else body end as body from stored_pages where json_valid(body)),
    nodes as (select 'page' as rec_kind, page_id as rec_id, t.id, t.parent, t.type, t.value, t.key from once, json_tree(body) t where json_valid(body)),
    once_toc as (select docset_id, case when json_type(toc) = 'VARCHAR' then json_extract_string(toc, '$') else toc end as toc from docsets where json_valid(toc)),
    every as (select * from nodes union all select 'toc', docset_id, t.id, t.parent, t.type, t.value, t.key from once_toc, json_tree(toc) t where json_valid(toc)),
    numbered as (select *, row_number() over (partition by rec_kind, rec_id order by id) - 1 as obj_no from every where type = 'OBJECT'),
    arrays as (select * from every where type = 'ARRAY')
    select {cols} from (select n.rec_kind, n.rec_id, n.value, case when a.id is null then n.key else a.key end as member, cast(n.obj_no as integer) as obj_no, cast(coalesce(p.obj_no, q.obj_no, -1) as integer) as parent_no
    from numbered n left join numbered p on p.rec_kind = n.rec_kind and p.rec_id = n.rec_id and p.id = n.parent
        left join arrays a on a.rec_kind = n.rec_kind and a.rec_id = n.rec_id and a.id = n.parent
        left join numbered q on q.rec_kind = a.rec_kind and q.rec_id = a.rec_id and q.id = a.parent) {rest}"""


def _objects_sql(cols: str, rest: str = "") -> str:
    return _OBJECTS_SQL.replace("{cols}", cols).replace("{rest}", rest)


def _members_sql(fields: tuple[str, ...]) -> str:
    return ", ".join(f"json_extract_string(value, '$.{f}') as {f}" for f in fields)


@query(_objects_sql("rec_kind, rec_id, obj_no, parent_no"))
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every JSON object of a readable body or toc, with its nearest enclosing one."""
    pages = flatten_json(table(spark, d, "stored_pages"), "body", {"page_id": "long"})
    tocs = flatten_json(table(spark, d, "docsets"), "toc", {"docset_id": "long"})
    return pages.select(F.lit("page").alias("rec_kind"), F.col("page_id").alias("rec_id"), "obj_no", "parent_no").unionByName(tocs.select(F.lit("toc").alias("rec_kind"), F.col("docset_id").alias("rec_id"), "obj_no", "parent_no"))


@query(_objects_sql("page_id, source_id, path, obj_no, parent_no, member, " + _members_sql(NODE_FIELDS), "join stored_pages s on s.page_id = rec_id where rec_kind = 'page'"))
def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The tree nodes of all pages as one flat table with parent links."""
    return flatten_json(table(spark, d, "stored_pages"), "body", {"page_id": "long", "source_id": "string", "path": "string"}, fields=NODE_FIELDS, with_key=True)


@query(_objects_sql("docset_id, source_id, obj_no, parent_no, " + _members_sql(TOC_FIELDS), "join docsets s on s.docset_id = rec_id where rec_kind = 'toc'"))
def p2_toc_entries(spark: SparkSession, d: str) -> DataFrame:
    """The table-of-contents entries of all docsets as one flat table with parent links."""
    return flatten_json(table(spark, d, "docsets"), "toc", {"docset_id": "long", "source_id": "string"}, fields=TOC_FIELDS)


# Skewed keys ---------------------------------------------------------------


def _bare(path: str = "path"):
    return F.regexp_replace(path, "^/", "")


@query("""
    select s.id as source_id from sources s left join (
        select source_id, count(distinct regexp_replace(path, '^/', '')) as n from pages
        where snapshot_no = (select max(snapshot_no) from pages) group by source_id
    ) p on p.source_id = s.id where coalesce(s.page_count, 0) <> coalesce(p.n, 0)""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose page_count isn't their number of distinct paths in the latest snapshot (null and none count as 0)."""
    pages = table(spark, d, "pages")
    latest = pages.agg(F.max("snapshot_no")).first()[0]
    held = key_stats(pages.where(F.col("snapshot_no") == F.lit(latest)).select("source_id", _bare().alias("path")), "source_id", "path")
    sources = table(spark, d, "sources").select(F.col("id").alias("source_id"), "page_count")
    both = sources.join(held.select("source_id", "n_distinct"), "source_id", "left")
    return both.where(F.coalesce("page_count", F.lit(0)) != F.coalesce("n_distinct", F.lit(0))).select("source_id")


@query("""
    select source_id, count(*) as n_rows, count(distinct regexp_replace(path, '^/', '')) as n_distinct,
        min(regexp_replace(path, '^/', '')) as min_value, max(regexp_replace(path, '^/', '')) as max_value
    from pages group by source_id""")
def p5_source_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct paths of each source over all snapshots."""
    return key_stats(table(spark, d, "pages").select("source_id", _bare().alias("path")), "source_id", "path").drop("n_chunks")


@query("""
    select source_id, snapshot_no, path, ordinal, count(*) as copies, min(row_no) as first_no, max(row_no) as last_no from (
        select source_id, snapshot_no, path, ordinal,
            row_number() over (partition by source_id order by snapshot_no, path, ordinal) - 1 as row_no from pages)
    group by all""")
def p5_numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Exact positions of the rows of each source; equal rows share a span of them."""
    rows = number_rows(table(spark, d, "pages"), "source_id", ["snapshot_no", "path", "ordinal"])
    return rows.groupBy("source_id", "snapshot_no", "path", "ordinal").agg(F.count("*").alias("copies"), F.min("row_no").alias("first_no"), F.max("row_no").alias("last_no"))


# Snapshots -----------------------------------------------------------------

_SNAP_SQL = """
    with clean as (
        select snapshot_no, source_id, regexp_replace(path, '^/', '') as path, fetched_at,
            regexp_replace(lower(content_hash), '^sha256:', '') as content_hash, title from pages),
    one as (
        select snapshot_no, source_id, path, max({{'t': fetched_at, 'h': content_hash, 'n': title}}) as best from clean group by all),
    steps as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) as before from (select distinct snapshot_no from pages)),
    cur as (select o.*, s.before from one o join steps s using (snapshot_no) where s.before is not null),
    old as (select s.snapshot_no as into_no, o.source_id, o.path, o.best from one o join steps s on s.before = o.snapshot_no)
    select {cols} from cur c full join old p on c.snapshot_no = p.into_no and c.source_id = p.source_id and c.path = p.path
    where {where}"""


def _snap_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("snapshot_no", "source_id", _bare().alias("path"), "fetched_at", F.regexp_replace(F.lower("content_hash"), "^sha256:", "").alias("content_hash"), "title")


@query(
    _SNAP_SQL.format(
        cols="coalesce(c.snapshot_no, p.into_no) as snapshot_no, coalesce(c.source_id, p.source_id) as source_id, coalesce(c.path, p.path) as path, case when p.path is null then 'added' when c.path is null then 'removed' else 'changed' end as change_kind",
        where="p.path is null or c.path is null or c.best.h is distinct from p.best.h",
    )
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages added, removed or changed (by content hash) against the snapshot before."""
    return snapshot_changes(_snap_rows(spark, d), "snapshot_no", ["source_id", "path"], ["content_hash"], "fetched_at").select("snapshot_no", "source_id", "path", "change_kind")


@query(
    _SNAP_SQL.format(
        cols="coalesce(c.snapshot_no, p.into_no) as snapshot_no, coalesce(c.source_id, p.source_id) as source_id, coalesce(c.path, p.path) as path, case when p.path is null then 'added' when c.path is null then 'removed' else 'changed' end as change_kind, case when p.path is null or c.path is null then '' else concat_ws(',', case when c.best.h is distinct from p.best.h then 'content_hash' end, case when c.best.n is distinct from p.best.n then 'title' end) end as changed_fields",
        where="p.path is null or c.path is null or c.best.h is distinct from p.best.h or c.best.n is distinct from p.best.n",
    )
)
def p6_field_changes(spark: SparkSession, d: str) -> DataFrame:
    """As p6_found, but a new title is a change too, and the changed fields are named."""
    return snapshot_changes(_snap_rows(spark, d), "snapshot_no", ["source_id", "path"], ["content_hash", "title"], "fetched_at").withColumn("changed_fields", F.array_join("changed_fields", ","))
