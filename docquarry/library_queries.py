"""Registered queries of the library's own operators: identifiers, text, catalogue,
reconciling, retrieval, evaluation, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions import ids, text, urls
from docquarry.model.fields import PATH_KINDS
from docquarry.model.fields import symbol_of_path as symbol_of
from docquarry.operators import catalog, detect, evaluation, graph, index, pages, reconcile, search
from docquarry.operators.keychunks import number_rows
from docquarry.plans import ingest
from docquarry.queries import query
from docquarry.runtime import cut, ensure_checkpoint_dir, table
from docquarry.streaming.ingest import windowed_counts

# Identifiers and URLs ------------------------------------------------------


@query("select id, regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9._+-]{0,63}') as valid from sources")
def source_id_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", ids.source_id_valid("id").alias("valid"))


@query(r"""
    select distinct path, octet_length(encode(path)) <= 2048 and path not like '%\%' and position(chr(0) in path) = 0
        and len(list_filter(string_split(path, '/'), lambda x: x in ('', '.', '..'))) = 0 as valid from pages""")
def page_path_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("path").distinct().select("path", ids.page_path_valid("path").alias("valid"))


@query("select content_hash, regexp_full_match(content_hash, '[0-9a-f]{64}') as valid, count(*) as n from pages group by all")
def content_hash_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy("content_hash", ids.content_hash_valid("content_hash").alias("valid")).agg(F.count("*").alias("n"))


@query("select raw_id, sha256(html) as content_hash from raw_pages")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").select("raw_id", ids.content_hash("html").alias("content_hash"))


_PATH_SQL = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_HOST_SQL = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(rf"""
    select raw_id, case when p = '' or p like '%/' then p || 'index.html'
        when len(list_filter(string_split(p, '/'), lambda x: x in ('', '.', '..'))) > 0 then 'pages/' || sha256(url)[:16] || '.html' else p end as path
    from (select raw_id, url, regexp_replace({_PATH_SQL}, '^/', '') as p from raw_pages)""")
def url_to_page_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").select("raw_id", urls.page_path("url").alias("path"))


@query(rf"""
    select raw_id, case when not regexp_matches(r.url, '^https?:') then 'wrong_scheme'
        when regexp_extract({_HOST_SQL.format("r.url")}, '([^.]*\.)?[^.]*$') <> regexp_extract({_HOST_SQL.format("s.url")}, '([^.]*\.)?[^.]*$') then 'off_host'
        when regexp_matches({_PATH_SQL.replace("url", "r.url")}, '^/(api|ref)/') then 'excluded'
        when not regexp_matches({_PATH_SQL.replace("url", "r.url")}, '[a-m]') then 'not_included' else 'in_scope' end as verdict
    from raw_pages r join sources s on s.id = r.source_id where s.url is not null""")
def url_scope_verdict(spark: SparkSession, d: str) -> DataFrame:
    entry = table(spark, d, "sources").where("url is not null").select(F.col("id").alias("source_id"), F.col("url").alias("entry"))
    met = table(spark, d, "raw_pages").join(entry, "source_id")
    return met.select("raw_id", urls.scope("url", "entry", ["[a-m]"], ["^/(api|ref)/"]).alias("verdict"))


_HREFS_SQL = """unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from raw_pages"""


def _hrefs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'))).alias("href"))


@query(f"""
    select case when href like '#%' then 'fragment' when href like '//%' or regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then 'external' else 'page' end as link_class,
        count(*) as n from (select {_HREFS_SQL}) group by 1""")
def link_classes(spark: SparkSession, d: str) -> DataFrame:
    return _hrefs(spark, d).groupBy(urls.link_class("href").alias("link_class")).agg(F.count("*").alias("n"))


@query(f"select lower(regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, count(*) as n from (select {_HREFS_SQL}) group by 1")
def link_schemes(spark: SparkSession, d: str) -> DataFrame:
    return _hrefs(spark, d).groupBy(urls.link_scheme("href").alias("scheme")).agg(F.count("*").alias("n"))


@query(r"""
    select site, regexp_replace(regexp_replace(lower(array_to_string(list_filter(labels[1:greatest(len(labels) - 1, 1)], lambda x: x not in ('www', 'docs', 'doc')), '-')), '[^a-z0-9._+-]+', '-', 'g'), '^[^a-z0-9]+|-+$', '', 'g')[:64] as proposed
    from (select distinct lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as site,
        string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '.') as labels from raw_pages)""")
def source_ids_from_urls(spark: SparkSession, d: str) -> DataFrame:
    """Ids proposed for the pages' sites."""
    site = F.concat_ws("://", urls.scheme("url"), urls.host("url"))
    return table(spark, d, "raw_pages").select(site.alias("site")).distinct().select("site", urls.source_id_from_url("site").alias("proposed"))


# Text ----------------------------------------------------------------------

_TOKENS_SQL = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' and octet_length(encode(t)) <= 40)"


@query(f"select term, count(*) as n, count(distinct doc_id) as df from (select doc_id, unnest({_TOKENS_SQL.format('text')}) as term from documents) group by term")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "documents").select("doc_id", F.explode(text.default_tokens("text")).alias("term"))
    per_doc = terms.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


@query(f"select doc_id, len({_TOKENS_SQL.format('text')}) as n from documents")
def document_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.default_tokens("text")).alias("n"))


_PLAIN_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || array_to_string(list_filter(regexp_split_to_array(translate(case when (length(text) - length(replace(text, chr(34), ''))) % 2 = 0 then text else replace(text, chr(34), ' ') end, '+-!():^[]{}~*?\\/&|<>=', repeat(' ', 21)), '\\s+'), lambda w: w <> ''), ' ') || ' ', ' AND ', ' and ', 'g'), ' OR ', ' or ', 'g'), ' NOT ', ' not ', 'g'), ' IN ', ' in ', 'g'))"


@query(f"select item_id, {_PLAIN_SQL} as q from eval_items")
def plain_text_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", text.plain_text_query("text").alias("q"))


_STOP_SQL = ", ".join(f"'{w}'" for w in text.QUESTION_WORDS + text.FUNCTION_WORDS)


@query(f"""
    select item_id, case when text like '%"%' or len(kept) = 0 then text else array_to_string(kept, ' ') end as q from (
        select item_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' and lower(w) not in ({_STOP_SQL})) as kept from eval_items)""")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", text.drop_stopwords("text").alias("q"))


@query(r"""
    select distinct w as word, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(w, '([\p{Ll}\p{N}])(\p{Lu})', '\1_\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1_\2', 'g')), '[_-]+'), lambda p: p <> ''), ' ') as parts
    from (select unnest(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_-]+'), lambda t: t <> '')) as w from documents)""")
def identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select(F.explode(text.code_words("text")).alias("word")).distinct()
    return found.select("word", F.lower(F.array_join(text.code_parts(F.col("word")), " ")).alias("parts"))


@query(r"""
    with found as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_-]+'), lambda t: t <> '') as ws from documents)),
    split as (select doc_id, i, w, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(w, '([\p{Ll}\p{N}])(\p{Lu})', '\1_\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1_\2', 'g'), '[_-]+'), lambda p: p <> '') as ps from found),
    placed as (select doc_id, w, ps, sum(len(ps)) over (partition by doc_id order by i rows unbounded preceding) - len(ps) as at_no from split),
    tokens as (select doc_id, lower(w) as token, cast(at_no as integer) as pos, len(ps) as len from placed where len(ps) > 1
        union all select doc_id, lower(p), cast(at_no + j - 1 as integer), 1 from (select doc_id, at_no, unnest(ps) as p, generate_subscripts(ps, 1) as j from placed))
    select * from tokens where octet_length(encode(token)) <= 120""")
def code_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Code tokens of the documents with their positions."""
    return table(spark, d, "documents").select("doc_id", F.inline(text.code_tokens("text")))


@query("""
    select path, case when len(parts) = 2 and parts[2] <> '' and kind is not null then parts[2] end as symbol, case when len(parts) = 2 and parts[2] <> '' then kind end as kind from (
        select path, parts, case """ + " ".join(f"when parts[1] = '{k}' then '{v}'" for k, v in PATH_KINDS.items()) + """ end as kind
        from (select distinct path, string_split(regexp_replace(list_last(string_split(path, '/')), '\\.html$', ''), '.') as parts from hits))""")
def symbol_of_path(spark: SparkSession, d: str) -> DataFrame:
    """The symbol a file name declares."""
    paths = table(spark, d, "hits").select("path").distinct()
    return pages.map_rows(paths, {"path": "string"}, {"path": F.col("path")}, {"symbol": "string", "kind": "string"}, lambda p: [(symbol_of(p or "") or (None, None))])


@query(r"""
    select distinct title, trim(regexp_replace(lower(title), '[\s"''`]+', '-', 'g'), '-') as slug,
        replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped,
        regexp_replace(title, '[\s"''`]', '', 'g') as clean, nullif(regexp_replace(lower(title), '[^a-z0-9-]', '', 'g'), '') as token from hits""")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    """Titles as slugs, escaped, as ids and as class tokens."""
    c = "title"
    return table(spark, d, "hits").select(c).distinct().select(c, text.slug(c).alias("slug"), text.html_escape(c).alias("escaped"), text.clean_id(c).alias("clean"), text.clean_token(c).alias("token"))


@query("select id, '/' || array_to_string(list_filter(list_transform(string_split(category, '/'), lambda x: trim(x)), lambda x: x <> ''), '/') as facet from sources")
def category_facets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", text.facet_path("category").alias("facet"))


# Detection -----------------------------------------------------------------

_DETECT_SQL = "case " + " ".join(f"when {' or '.join(f'''contains(h, '{m}')''' for m in marks)} then '{p}'" for p, _, marks in detect.RULES) + " else 'generic' end"
_SURE_SQL = "case " + " ".join(f"when {' or '.join(f'''contains(h, '{m}')''' for m in marks)} then {c}" for _, c, marks in detect.RULES) + " else 0.4 end"


@query(f"select raw_id, {_DETECT_SQL} as platform, cast({_SURE_SQL} as double) as confidence from (select raw_id, lower(html) as h from raw_pages)")
def platform_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").select("raw_id", detect.platform(F.col("html")).alias("platform"), detect.confidence(F.col("html")).alias("confidence"))


@query(f"""
    select expected, {', '.join(f"count(*) filter (platform = '{p}') as {p}" for p in ids.PLATFORMS)}
    from (select s.kind as expected, {_DETECT_SQL} as platform from (select source_id, lower(html) as h from raw_pages) r join sources s on s.id = r.source_id) group by expected""")
def detect_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Platforms found on the pages of each kind of source."""
    kinds = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("kind").alias("expected"))
    found = table(spark, d, "raw_pages").join(kinds, "source_id").select("expected", detect.platform(F.col("html")).alias("platform"))
    return evaluation.confusion(found, "expected", "platform", ids.PLATFORMS)


@query("select kind, n, n / total as share, n / total < 0.5 as balanced from (select kind, count(*) as n, sum(count(*)) over () as total from sources group by kind)")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.class_balance(table(spark, d, "sources"), "kind")


# Catalogue -----------------------------------------------------------------


@query("select id, name, category, row_number() over (order by lower(name), id) as place from sources")
def list_sources_nocase(spark: SparkSession, d: str) -> DataFrame:
    order = W.orderBy(F.collate("name", "UTF8_LCASE"), "id")
    return table(spark, d, "sources").select("id", "name", "category", F.row_number().over(order).alias("place"))


@query("select source_id, path, ordinal, row_number() over (partition by source_id order by ordinal, path, fetched_at, content_hash) as place from pages where snapshot_no = (select max(snapshot_no) from pages)")
def list_pages_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The pages of the latest snapshot in their order. A few sources hold most pages, so
    rows are numbered by offsets and no task holds a whole source."""
    latest = _last_two(spark, d)[0]
    rows = table(spark, d, "pages").where(F.col("snapshot_no") == F.lit(latest).cast("int"))
    return number_rows(rows, "source_id", ["ordinal", "path", "fetched_at", "content_hash"]).select("source_id", "path", "ordinal", (F.col("row_no") + 1).alias("place"))


@query("select source_id, ordinal, path from pages order by source_id, ordinal, path limit 200 offset 400")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    """A page of the listing; offset and limit are the feature."""
    return catalog.paged(table(spark, d, "pages").select("source_id", "ordinal", "path"), 400, 200)


@query("select s.id, s.name, coalesce(n, 0) as n_pages from sources s left join (select source_id, count(*) as n from pages group by 1) p on p.source_id = s.id")
def sources_with_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.sources_with_counts(table(spark, d, "sources"), table(spark, d, "pages")).select("id", "name", "n_pages")


@query("select id from sources where id not in (select source_id from stored_pages where source_id is not null)")
def never_pulled(spark: SparkSession, d: str) -> DataFrame:
    return catalog.never_pulled(table(spark, d, "sources"), table(spark, d, "stored_pages")).select("id")


@query(r"select distinct a.id from sources a join sources b on rtrim(a.url, '/') = rtrim(b.url, '/') union select id from sources")
def duplicate_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that couldn't be added again, by id or URL."""
    s = table(spark, d, "sources")
    return catalog.duplicates(s, s).select("id").distinct()


@query(r"""
    select id, case when json_extract_string(sync, '$.pin_version') = 'true' then 'pinned' when strategy = 'manual' then 'only_manually' when strategy = 'on_launch' then 'not_yet'
        when strategy = 'scheduled' then case when last_synced is null or timestamptz '2025-02-11 00:00:00+00' - last_synced >= to_days(days) then 'now' else 'not_yet' end
        when strategy = 'watch' then 'watch_undecided' end as due
    from (select id, sync, last_synced, json_extract_string(sync, '$.strategy.strategy') as strategy,
        case json_extract_string(sync, '$.strategy.schedule') when 'daily' then 1 when 'weekly' then 7 when 'monthly' then 30 end as days from sources)""")
def sync_due(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sync_states(table(spark, d, "sources"), "tick", F.lit("2025-02-11 00:00:00").cast("timestamp"))


# Reconciling ---------------------------------------------------------------

_LATEST_SQL = """
    with no as (select snapshot_no as n, row_number() over (order by snapshot_no desc) as back from (select distinct snapshot_no from pages where snapshot_no is not null)),
    one as (select snapshot_no, source_id, regexp_replace(path, '^/', '') as path, max({'t': fetched_at, 'h': regexp_replace(lower(content_hash), '^sha256:', '')}).h as h
        from pages group by all),
    old as (select * from one where snapshot_no in (select n from no where back = 2)), new as (select * from one where snapshot_no in (select n from no where back = 1))"""


def _last_two(spark: SparkSession, d: str) -> tuple[int | None, int | None]:
    """Numbers of the latest snapshot and of the one before, null where there is none."""
    found = table(spark, d, "pages").select("snapshot_no").dropna().distinct().orderBy(F.desc("snapshot_no")).limit(2).collect()
    latest, before = ([r.snapshot_no for r in found] + [None, None])[:2]
    return latest, before


def _snapshot(spark: SparkSession, d: str, n: int | None) -> DataFrame:
    rows = table(spark, d, "pages").where(F.col("snapshot_no") == F.lit(n).cast("int")).select("source_id", ids.clean_path("path").alias("path"), "fetched_at", ids.clean_hash("content_hash").alias("content_hash"))
    return rows.groupBy("source_id", "path").agg(F.max(F.struct("fetched_at", "content_hash")).alias("m")).select("source_id", "path", "m.content_hash")


@query(_LATEST_SQL + """
    select coalesce(n.source_id, o.source_id) as source_id, coalesce(n.path, o.path) as path,
        case when o.path is null then 'add' when n.path is null then 'remove' when n.h is not distinct from o.h then 'keep' else 'update' end as action
    from new n full join old o on n.source_id = o.source_id and n.path = o.path""")
def index_diff(spark: SparkSession, d: str) -> DataFrame:
    latest, before = _last_two(spark, d)
    return reconcile.diff(_snapshot(spark, d, latest), _snapshot(spark, d, before))


@query(_LATEST_SQL + "select source_id, path, h as content_hash from old o where exists (select 1 from new n where n.source_id = o.source_id and n.path = o.path)")
def prune_missing(spark: SparkSession, d: str) -> DataFrame:
    latest, before = _last_two(spark, d)
    new = _snapshot(spark, d, latest)
    return reconcile.prune_missing(_snapshot(spark, d, before), new, reconcile.CrawlOutcome(1))


@query(_LATEST_SQL + "select source_id, path, h as content_hash from new union all select source_id, path, h from old o where not exists (select 1 from new n where n.source_id = o.source_id and n.path = o.path)")
def upsert_pages(spark: SparkSession, d: str) -> DataFrame:
    latest, before = _last_two(spark, d)
    return reconcile.upsert(_snapshot(spark, d, before), _snapshot(spark, d, latest), ["source_id", "path"])


@query("""
    select coalesce(a.source_id, b.source_id) as source_id, coalesce(n, 0) as n_stored, coalesce(m, 0) as n_indexed, coalesce(n, 0) = coalesce(m, 0) as agrees
    from (select source_id, count(*) as n from stored_pages group by 1) a full join (select source as source_id, count(*) as m from documents group by 1) b on a.source_id = b.source_id""")
def index_db_agreement(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.agreement(table(spark, d, "stored_pages"), table(spark, d, "documents").withColumnRenamed("source", "source_id"))


@query("select name, case when w is null then 'missing' when g is null then 'orphan' when g = w then 'pass' else 'mismatch' end as state from (" + _LATEST_SQL + "select coalesce(n.source_id, o.source_id) || ' ' || coalesce(n.path, o.path) as name, n.h as g, o.h as w from new n full join old o on n.source_id = o.source_id and n.path = o.path)")
def golden_diff(spark: SparkSession, d: str) -> DataFrame:
    """The latest pages as outputs, the ones before as goldens."""
    new, old = (_snapshot(spark, d, n).select(F.concat_ws(" ", "source_id", "path").alias("name"), F.col("content_hash").alias("value")) for n in _last_two(spark, d))
    return evaluation.golden(new, old)


# Retrieval -----------------------------------------------------------------

#: The items whose id is divisible by 50 are the queries, as for every search here.
_ASKED_SQL = "select item_id as query_id, text as q from eval_items where item_id % 50 = 0"
_BM25_SQL = f"""
    with asked as ({_ASKED_SQL}),
    terms as (select query_id, term, count(*) as weight from (select query_id, unnest({_TOKENS_SQL.format("cleaned")}) as term from (
        select query_id, case when len(kept) = 0 then q else array_to_string(kept, ' ') end as cleaned from (
            select query_id, q, list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '' and lower(w) not in ({_STOP_SQL})) as kept from (
                select query_id, {_PLAIN_SQL.replace("text", "q")} as q from asked)))) group by all),
    tokens as (select doc_id, source, {_TOKENS_SQL.format("text")} as t, length(text) as chars from documents),
    lens as (select doc_id, len(t) as n from tokens), stats as (select count(*) as n_docs, avg(n) as avg_len from lens),
    post as (select term, doc_id, count(*) as tf from (select doc_id, unnest(t) as term from tokens) group by all),
    freq as (select term, count(*) as df from post where term in (select term from terms) group by term),
    scored as (select query_id, doc_id, sum(weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) as score
        from terms join freq using (term) join post using (term) join lens using (doc_id), stats group by all),
    final as (select query_id, s.doc_id, source, case when chars > 4000 then score / (1 + 1.6 * ln(chars / 4000)) else score end as score from scored s join tokens t using (doc_id))
    select query_id, hit_rank, doc_id, score from (
        select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as hit_rank from final where {{scope}}) where hit_rank <= 10"""
_BODY = search.Ranking({"body": 1.0}, max_distance=0)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def _document_index(spark: SparkSession, d: str) -> index.Index:
    docs = table(spark, d, "documents")
    return index.build(docs, ["doc_id"], {"body": index.placed_tokens(F.col("text"))}, {"source": F.col("source"), "body_chars": F.length("text")})


@query(_BM25_SQL.replace("{scope}", "true"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents per query, with length penalty."""
    return search.search(_document_index(spark, d), _asked(spark, d), 10, _BODY)


@query(_BM25_SQL.replace("{scope}", "source = 'inlinzo'"))
def scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same within one source; statistics stay global."""
    return search.search(_document_index(spark, d), _asked(spark, d), 10, _BODY, F.col("source") == "inlinzo")


def _shared_folder(spark: SparkSession) -> str:
    """A new folder on the session's shared storage."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"


@query(_BM25_SQL.replace("{scope}", "true"))
def stored_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same over an index that was written and grew by commits: every document with an even
    id came first with another text and was replaced, one document was added and deleted."""
    at, docs = _shared_folder(spark), table(spark, d, "documents").select("doc_id", "source", "text")

    def built(df: DataFrame) -> index.Index:
        return index.build(df, ["doc_id"], {"body": index.placed_tokens(F.col("text"))}, {"source": F.col("source"), "body_chars": F.length("text")})

    early = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.reverse("text")).otherwise(F.col("text")))
    extra = spark.createDataFrame([(-1, "x", "finally the mandatory")], docs.schema)
    index.commit(at, built(early.unionByName(extra)))
    index.commit(at, built(docs.where("doc_id % 2 = 0")), extra.select("doc_id"))
    return search.search(index.load_segments(spark, at, ["doc_id"]), _asked(spark, d), 10, _BODY)


@query(r"""
    select distinct p.phrase, doc_id from (values ('the mandatory'), ('do not pass'), ('finally the')) p(phrase),
        (select doc_id, ' ' || array_to_string(""" + _TOKENS_SQL.format("text") + """, ' ') || ' ' as t from documents) where contains(t, ' ' || phrase || ' ')""")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a quoted phrase."""
    asked = spark.createDataFrame([(1, '"the mandatory"'), (2, '"do not pass"'), (3, '"finally the"')], "query_id long, q string")
    built, said = _document_index(spark, d), search.phrases(asked, _BODY)
    found = search.phrase_scores(built, said, search.matched(built, said))
    return found.join(said.select("query_id", "phrase").distinct(), "query_id").select("phrase", "doc_id")


@query()
def page_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten best stored pages per query over all fields, with correction and phrases."""
    return search.search(ingest.index_of(table(spark, d, "stored_pages")), _asked(spark, d))


@query()
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    """Pages that declare a symbol."""
    asked = spark.createDataFrame([(1, "@inlinzo"), (2, "@bitel @dastovi")], "query_id long, q string")
    return search.search(ingest.index_of(table(spark, d, "stored_pages")), asked, 50)


@query(f"""
    with asked as ({_ASKED_SQL}), said as (select distinct query_id, unnest({_TOKENS_SQL.format("q")}) as w from asked),
    typed as (select query_id, w[:3] || w[5] || w[4] || w[6:] as typed, case when length(w) <= 6 then 1 else 2 end as far from said where length(w) >= 6),
    words as (select term, count(distinct doc_id) as df from (select doc_id, unnest({_TOKENS_SQL.format("text")}) as term from documents) group by term),
    near as (select query_id, typed, term, df, damerau_levenshtein(term, typed) as distance from typed join words on term[:3] = typed[:3] and abs(length(term) - length(typed)) <= far
        where typed not in (select term from words) and lower(typed) not in ({_STOP_SQL}) and damerau_levenshtein(term, typed) <= far)
    select query_id, typed, term as meant from near qualify row_number() over (partition by query_id, typed order by distance, df desc, term) = 1""")
def spelling_corrections(spark: SparkSession, d: str) -> DataFrame:
    """What was meant by query words whose fourth and fifth letters were swapped."""
    words = _asked(spark, d).select("query_id", F.explode(text.default_tokens("q")).alias("w")).distinct()
    typed = words.where("length(w) >= 6").select("query_id", F.concat(F.substring("w", 1, 3), F.substring("w", 5, 1), F.substring("w", 4, 1), F.substring("w", 6, 100)).alias("w"))
    asked = typed.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("q"))
    built, terms = _document_index(spark, d), search.query_terms(asked, search.Ranking({"body": 1.0}))
    return search.corrections(built, search.unknown_terms(terms, search.matched(built, terms)))


@query("""
    select user_id, q, last_used, place from (select *, row_number() over (partition by user_id order by last_used desc, q) as place from (
        select user_id, trim(props)[:200] as q, max(ts) as last_used from events where trim(props) <> '' group by all)) where place <= 50""")
def search_history(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 distinct entries of each user."""
    return search.history(table(spark, d, "events"), "user_id", "props", "ts")


# Evaluation ----------------------------------------------------------------

_WANTED_SQL = """
    with one as (select distinct query_id, hit_rank, path from hits),
    want as (select query_id, min(path) as path from one group by 1), want2 as (select query_id, max(path) as path from one group by 1),
    r1 as (select w.query_id, coalesce(min(hit_rank) filter (hit_rank <= 10), 0) as rank from want w left join one o on o.query_id = w.query_id and o.path = w.path group by 1),
    r2 as (select w.query_id, coalesce(min(hit_rank) filter (hit_rank <= 10), 0) as rank from want2 w left join one o on o.query_id = w.query_id and o.path = w.path group by 1)"""


def _ranks(spark: SparkSession, d: str, pick: str) -> DataFrame:
    hits = table(spark, d, "hits").select("query_id", "hit_rank", "path").distinct()
    labels = hits.groupBy("query_id").agg((F.min if pick == "first" else F.max)("path").alias("path"))
    return evaluation.first_relevant(hits, hits, labels, ["path"])


@query(_WANTED_SQL + """
    select kind, count(*) as n, round(avg(case when rank > 0 then 1 / rank else 0 end), 6) as mrr, round(avg(case when rank = 1 then 1.0 else 0 end), 6) as recall_at_1,
        round(avg(case when rank between 1 and 3 then 1.0 else 0 end), 6) as recall_at_3, round(avg(case when rank between 1 and 10 then 1.0 else 0 end), 6) as recall_at_10
    from (select *, case when query_id % 2 = 0 then 'even' else 'odd' end as kind from r1) group by rollup (kind)""")
def mrr_recall_by_kind(spark: SparkSession, d: str) -> DataFrame:
    ranks = _ranks(spark, d, "first").withColumn("kind", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    m = evaluation.metrics(ranks, "kind")
    return m.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_at_1", "recall_at_3", "recall_at_10")])


@query(_WANTED_SQL + """
    select query_id, a.rank as old, b.rank as new, case when a.rank = b.rank then 'same' when b.rank = 0 then 'worse' when a.rank = 0 then 'better' when b.rank < a.rank then 'better' else 'worse' end as moved
    from r1 a join r2 b using (query_id)""")
def rank_movement(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.movement(_ranks(spark, d, "first"), _ranks(spark, d, "last"))


@query("""
    select l_returnflag, min(l_extendedprice) filter (upto >= ceil(total * 0.5)) as p50, min(l_extendedprice) filter (upto >= ceil(total * 0.95)) as p95 from (
        select l_returnflag, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice) as upto, count(*) over (partition by l_returnflag) as total from lineitem)
    group by 1""")
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.nearest_rank(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", [0.5, 0.95])


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """The streaming window count over a bounded input."""
    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


# Pages ---------------------------------------------------------------------

#: Link targets of the fetched pages, resolved: scripts and comments aside, fragments dropped.
_LINKS_SQL = r"""
    with bare as (select distinct regexp_replace(url, '#.*$', '') as url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<textarea\b.*?</textarea\s*>|<title\b.*?</title\s*>', '', 'g') as h from raw_pages where html is not null),
    refs as (select url, unnest(regexp_extract_all(h, '(?i)<a\s[^>]*?href=("[^"]*"|''[^'']*'')', 1)) as raw from bare),
    parts as (select url, regexp_replace(trim(raw[2:-2]), '#.*$', '') as href, regexp_extract(url, '^[^:]+://[^/?#]*') as root, regexp_extract(url, '^[^?#]*/') as folder from refs),
    edges as (select distinct url as src, case when href = '' then url when href like '/%' then root || href else folder || href end as dst from parts)"""

#: Text strings of the readable bodies, unwrapped if they were encoded twice.
_TEXTS_SQL = """
    with once as (select page_id, source_id, path, case when json_type(body) = 'VARCHAR' then json_extract_string(body, '$') else body end as body from stored_pages where json_valid(body)),
    readable as (select * from once where json_valid(body) and json_type(body) = 'OBJECT'),
    strings as (select r.page_id, r.source_id, r.path, t.id as nth, json_extract_string(t.value, '$') as s from readable r, json_tree(r.body) t where t.key in ('value', 'code', 'alt') and t.type = 'VARCHAR')"""

_PAGE = {"page_id": "long", "source_id": "string", "path": "string"}


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "sources").select(F.col("id").alias("source_id"), "kind")
    return pages.parse_pages(table(spark, d, "raw_pages").join(kinds, "source_id", "left"), {"raw_id": "long", "url": "string"}, kind=F.col("kind"))


def _addressed(spark: SparkSession, d: str) -> DataFrame:
    """The pages' addresses, without fragments, and their links."""
    return _parsed(spark, d).select(F.regexp_replace("url", "#.*$", "").alias("url"), "links")


@query()
def parsed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Fetched pages parsed, normalized and sanitized."""
    return _parsed(spark, d).drop("links")


@query(_LINKS_SQL + """
    , ends as (select src as node, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges) select node, sum(o) as n_out, sum(i) as n_in from ends group by node""")
def link_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Links out of and into every address the pages name."""
    return graph.degrees(graph.link_edges(_addressed(spark, d), "url", "links"))


@query(_LINKS_SQL + """
    select distinct url as node, 1 as depth from bare union all select distinct dst, 2 from edges where dst not in (select url from bare)""")
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Pages reached from the fetched ones within three steps."""
    found = cut(_addressed(spark, d))
    return graph.crawl(graph.link_edges(found, "url", "links"), found.select(F.col("url").alias("node")), 3)[0]


@query()
def ingested_pages(spark: SparkSession, d: str) -> DataFrame:
    """Fetched pages as they are stored: parsed, cleaned, relinked, one per path."""
    fetched = table(spark, d, "raw_pages").withColumn("ordinal", F.col("raw_id").cast("int"))
    return ingest.process(fetched, table(spark, d, "sources").select(F.col("id").alias("source_id"), "kind"))


@query()
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_fields(table(spark, d, "stored_pages"), _PAGE)


@query(_TEXTS_SQL + r"""
    , nodes as (select r.page_id, t.id as nth, t.fullkey as k, json_extract_string(t.value, '$.type') as kind, t.value as n from readable r, json_tree(r.body) t where t.type = 'OBJECT' and json_extract_string(t.value, '$.type') is not null),
    heads as (select page_id, k, nth from nodes where kind = 'heading'),
    inside as (select n.page_id, n.nth, h.nth as head from nodes n join heads h on h.page_id = n.page_id and starts_with(n.k, h.k || '.')),
    labels as (select i.page_id, i.head, trim(string_agg(x, ' ' order by nth)) as label from inside i join (select page_id, nth, json_extract_string(n, case kind when 'text' then '$.value' else '$.code' end) as x from nodes where kind in ('text', 'inline_code')) p using (page_id, nth) where x <> '' group by all),
    headers as (select page_id, string_agg(label, chr(10) order by head) as headers from labels where label <> '' group by 1),
    said as (select page_id, nth, kind, case kind when 'text' then json_extract_string(n, '$.value') when 'image' then json_extract_string(n, '$.alt') when 'link' then json_extract_string(n, '$.title')
            when 'admonition' then concat_ws(' ', nullif(json_extract_string(n, '$.kind'), ''), nullif(json_extract_string(n, '$.title'), '')) end as x, json_extract_string(n, '$.code') as c
        from nodes where (page_id, nth) not in (select (page_id, nth) from inside)),
    bodies as (select page_id, string_agg(x, ' ' order by nth) filter (x <> '') as body_text, string_agg(c, ' ' order by nth) filter (kind in ('code_block', 'inline_code') and c <> '') as code from said group by 1)
    select r.page_id, coalesce(headers, '') as headers, coalesce(body_text, '') as body_text, coalesce(code, '') as code from readable r left join headers using (page_id) left join bodies using (page_id)""")
def page_text_fields(spark: SparkSession, d: str) -> DataFrame:
    """The searched texts of each page: headings (a line each), body and code."""
    return pages.page_fields(table(spark, d, "stored_pages"), _PAGE).select("page_id", F.array_join("headers", "\n").alias("headers"), "body_text", "code")


@query()
def page_symbols(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_symbols(table(spark, d, "stored_pages"), _PAGE)


@query(_TEXTS_SQL + r"""
    , heads as (select r.page_id, r.source_id, r.path, t.id as nth, cast(json_extract(t.value, '$.level') as integer) as level, json_extract_string(t.value, '$.id') as own, t.value as node
        from readable r, json_tree(r.body) t where t.type = 'OBJECT' and json_extract_string(t.value, '$.type') = 'heading'),
    said as (select h.page_id, h.nth, string_agg(json_extract_string(x.value, '$'), '' order by x.id) as s from heads h, json_tree(h.node) x where x.key in ('value', 'code', 'alt') and x.type = 'VARCHAR' group by all),
    named as (select h.*, trim(regexp_replace(coalesce(s, ''), '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as text from heads h left join said using (page_id, nth)),
    wanted as (select *, coalesce(nullif(own, ''), nullif(regexp_replace(regexp_replace(lower(text), '[\s\x00-\x1f\x7f"''`]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') as w from named),
    counted as (select *, row_number() over (partition by page_id, w order by nth) as k from wanted),
    ranked as (select page_id, source_id, path, level, text, w || case when k > 1 then '-' || k else '' end as id, row_number() over (partition by page_id order by nth) - 1 as ord from counted where level <= 4)
    select t.*, coalesce((select max(o.ord) from ranked o where o.page_id = t.page_id and o.ord < t.ord and o.level < t.level), -1) as parent from ranked t""")
def page_outline(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_outline(table(spark, d, "stored_pages"), _PAGE)


@query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_markdown(table(spark, d, "stored_pages"), _PAGE)


@query()
def page_markdown_cut(spark: SparkSession, d: str) -> DataFrame:
    """The same, cut to a bounded size."""
    return pages.page_markdown_cut(table(spark, d, "stored_pages"), _PAGE)


@query()
def page_html(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_html(table(spark, d, "stored_pages"), _PAGE)


@query()
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_sections(table(spark, d, "stored_pages"), _PAGE)


@query()
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_blocks(table(spark, d, "stored_pages"), _PAGE)


@query()
def page_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Where 'sorter' or 'cursor' stands in each page."""
    asked = table(spark, d, "stored_pages").withColumn("terms", F.array(F.lit("sorter"), F.lit("cursor")))
    return pages.snippets(asked, _PAGE, "terms")


@query(_TEXTS_SQL + """
    , whole as (select page_id, source_id, path, lower(string_agg(s, '' order by nth)) as h from strings group by all),
    found as (select page_id, source_id, path, h, unnest(range(length(h))) as pos from whole where contains(h, 'inlinzo'))
    select page_id, source_id, path, row_number() over (partition by page_id order by pos) - 1 as ord, pos from found where substr(h, pos + 1, 7) = 'inlinzo'""")
def find_in_page(spark: SparkSession, d: str) -> DataFrame:
    return pages.find_in_page(table(spark, d, "stored_pages"), _PAGE, "inlinzo")
