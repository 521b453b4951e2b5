"""SQL of the training-text queries that SQL can express on whole tables."""

#: Readable bodies, unwrapped if they were encoded twice.
_READABLE = """
    once as (select page_id, source_id, path, case when json_type(body) = 'VARCHAR' then json_extract_string(body, '$') else body end as body from stored_pages where json_valid(body)),
    readable as (select * from once where json_valid(body) and json_type(body) = 'OBJECT')"""
#: Text strings of the bodies in document order.
_STRINGS = """
    strings as (select r.page_id, r.source_id, r.path, t.id as pos, json_extract_string(t.value, '$') as s from readable r, json_tree(r.body) t
        where t.key in ('value', 'code', 'alt') and t.type = 'VARCHAR')"""


def _words(c: str) -> str:
    return rf"regexp_extract_all(lower(replace(replace(nfc_normalize({c}), chr(173), ''), chr(8203), '')), '[\p{{L}}\p{{N}}]+')"


def _grams(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: list_slice({words}, i, i + {n - 1}))"


#: Lines of the bodies: every top-level element with its text and its letters.
_LINES = r"""
    blocks as (select r.page_id, r.source_id, r.path, cast(e.key as integer) as block_no, e.value as block from readable r, json_each(r.body, '$.children') e),
    parts as (select b.page_id, b.source_id, b.path, b.block_no, t.id as pos, json_extract_string(t.value, '$') as s from blocks b, json_tree(b.block) t where t.key in ('value', 'code', 'alt') and t.type = 'VARCHAR'),
    lines as (select page_id, source_id, path, block_no, coalesce(string_agg(s, '' order by pos), '') as line, coalesce(regexp_replace(lower(nfc_normalize(string_agg(s, '' order by pos))), '[^\p{L}]+', '', 'g'), '') as k
        from blocks left join parts using (page_id, source_id, path, block_no) group by all)"""

SQL: dict[str, str] = {
    "p1_found": rf"""
    with {_READABLE}, {_LINES},
    totals as (select source_id, count(distinct path) as n from readable group by 1),
    bad as (select source_id, k from lines join totals using (source_id) where k <> '' group by source_id, k, n having count(distinct path) >= 5 and count(distinct path) * 10 >= n)
    select page_id, block_no from lines join bad using (source_id, k)""",
    "p1_clean_pages": rf"""
    with {_READABLE}, {_LINES},
    totals as (select source_id, count(distinct path) as n from readable group by 1),
    bad as (select source_id, k from lines join totals using (source_id) where k <> '' group by source_id, k, n having count(distinct path) >= 5 and count(distinct path) * 10 >= n)
    select r.page_id, coalesce(string_agg(line, chr(10) order by block_no) filter (block_no is not null and b.k is null), '') as text,
        count(block_no) filter (b.k is null) as n_kept, count(b.k) as n_removed
    from readable r left join lines l using (page_id) left join bad b on b.source_id = l.source_id and b.k = l.k group by r.page_id""",
    "p1_line_counts": rf"""
    with {_READABLE}, {_LINES},
    docs as (select r.page_id, r.source_id, r.path, coalesce(list(k order by block_no) filter (k <> ''), []) as c from readable r left join lines l using (page_id) group by all),
    days as (select source_id, regexp_replace(path, '^/', '') as path, cast(min(fetched_at) as date) as day from pages group by all),
    clusters as (select d.source_id, c, min(day) as day from docs d left join days f on f.source_id = d.source_id and f.path = d.path group by all),
    totals as (select source_id, count(*) as n_total from clusters group by 1),
    held as (select distinct source_id, c, day, unnest(c) as k from clusters),
    counts as (select source_id, k, count(*) as n_clusters, count(distinct day) as n_dates from held group by all)
    select source_id as source, cast('0x' || md5(k)[:15] as bigint) as line_key, n_clusters, n_dates, n_total
    from counts join totals using (source_id) where n_clusters >= 5 and n_clusters * 10 >= n_total and n_dates >= 2""",
    "p3_found": f"""
    with {_READABLE}, {_STRINGS},
    texts as (select page_id, flatten(list({_words('s')} order by pos)) as w from strings group by 1),
    grams as (select distinct page_id, unnest({_grams('w', 3)}) as g from texts where len(w) >= 3),
    sizes as (select page_id, count(*) as n from grams group by 1),
    shared as (select a.page_id as page_id_a, b.page_id as page_id_b, count(*) as both_n from grams a join grams b on a.g = b.g and a.page_id < b.page_id group by all)
    select page_id_a, page_id_b from shared join sizes x on x.page_id = page_id_a join sizes y on y.page_id = page_id_b where both_n * 5 >= (x.n + y.n - both_n) * 3""",
    "p3_groups": f"""
    with recursive {_READABLE}, {_STRINGS},
    texts as (select page_id, flatten(list({_words('s')} order by pos)) as w from strings group by 1),
    grams as (select distinct page_id, unnest({_grams('w', 3)}) as g from texts where len(w) >= 3),
    sets as (select page_id, list(g order by g) as gs from grams group by 1),
    classes as (select page_id, min(page_id) over (partition by gs) as rep from sets),
    own as (select page_id, g from grams where page_id in (select rep from classes)),
    sizes as (select page_id, count(*) as n from own group by 1),
    shared as (select a.page_id as x, b.page_id as y, count(*) as both_n from own a join own b on a.g = b.g and a.page_id <> b.page_id group by all),
    links as (select x, y from shared join sizes s on s.page_id = x join sizes t on t.page_id = y where both_n * 5 >= (s.n + t.n - both_n) * 3),
    reach as (select distinct x as a, x as b from links union select r.a, l.y from reach r join links l on l.x = r.b),
    groups as (select a as rep, min(b) as group_id from reach group by 1), degrees as (select x as rep, count(*) as n from links group by 1)
    select s.page_id, coalesce(rep, s.page_id) as class_id, coalesce(n, 0) as n_links, coalesce(group_id, rep, s.page_id) as group_id
    from stored_pages s left join classes c on c.page_id = s.page_id left join degrees using (rep) left join groups using (rep)""",
    "p4_found": f"""
    with {_READABLE}, {_STRINGS},
    body as (select distinct source_id, path, unnest({_words('s')}) as term from strings),
    hit as (select distinct query_id, hit_rank, unnest({_words('title')}) as term from hits where title is not null),
    freq as (select 'body' as field_name, term, count(*) as n, (select count(*) from (select distinct source_id, path from readable)) as total from body group by term
        union all select 'title', term, count(*), (select count(*) from (select distinct query_id, hit_rank from hits)) from hit group by term)
    select field_name, term, case when n = 1 then 'rare' else 'common' end as mark from freq where n = 1 or n * 4 > total""",
    "p4_frequencies": f"""
    with {_READABLE}, {_STRINGS},
    body as (select source_id, path, unnest({_words('s')}) as term from strings),
    hit as (select query_id, hit_rank, unnest({_words('title')}) as term from hits where title is not null),
    freq as (select 'body' as field_name, term, count(*) as n_occurrences, count(distinct (source_id, path)) as n_records, (select count(*) from (select distinct source_id, path from readable)) as total from body group by term
        union all select 'title', term, count(*), count(distinct (query_id, hit_rank)), (select count(*) from (select distinct query_id, hit_rank from hits)) from hit group by term)
    select field_name, term, n_occurrences, n_records, case when n_records = 1 then 'rare' when n_records * 4 > total then 'common' end as mark from freq""",
    "p9_found": f"""
    with d as (select doc_id, {_words('text')} as w from documents), e as (select item_id, {_words('text')} as w from eval_items),
    dg as (select distinct doc_id, unnest({_grams('w', 12)}) as g from d where len(w) >= 12), eg as (select distinct item_id, unnest({_grams('w', 12)}) as g from e where len(w) >= 12)
    select distinct doc_id, item_id from dg join eg using (g)""",
}
