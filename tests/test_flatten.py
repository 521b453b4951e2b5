import json

import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.model.ast import CHILD_KEYS, read_json
from docquarry.operators.flatten import TOC_FIELDS, flatten_batch, flatten_json
from tests.conftest import rows


def brute(text, fields=()):
    value, out = read_json(text), []

    def go(v, parent):
        if isinstance(v, dict):
            me = len(out)
            out.append((me, parent, *[v[f] if isinstance(v.get(f), str) else None if isinstance(v.get(f), (dict, list)) or v.get(f) is None else json.dumps(v[f]) for f in fields]))
            for k in [k for k in CHILD_KEYS if k in v] + [k for k in v if k not in CHILD_KEYS]:
                go(v[k], me)
        elif isinstance(v, list):
            for x in v:
                go(x, parent)

    go(value, -1)
    return out


def kernel(texts, fields=()):
    f = flatten_batch(pa.array(texts, pa.string()), fields=fields)
    return sorted(zip(f.row.tolist(), f.obj_no.tolist(), f.parent_no.tolist(), *[f.fields[x].to_pylist() for x in fields]), key=repr), f.readable.tolist()


DIRTY = [
    '{"items":[{"definition":[{"a":1}],"term":[{"b":2},{"c":{"children":[{}]}}]}],"z":{},"children":{"value":"q\\"{"}}',
    None, "", "  ", '"abc"', "[]", '[1,[{"value":"é\\u00e9\\n"}],{}]', '{"a":', "12", "{}{}", '"{\\"a\\":', '{"rows":null,"headers":[{"cells":[{"value":true}]}]}',
    json.dumps(json.dumps(json.dumps({"children": [{"value": "\\\\"}]}))),
    json.dumps({"children": [{"value": "x"}]}, indent=2),
]


def test_dirty_records_match_a_parser():
    got, readable = kernel(DIRTY, ("value",))
    assert got == sorted([(i, *o) for i, t in enumerate(DIRTY) for o in brute(t, ("value",))], key=repr)
    assert readable == [read_json(t) is not None for t in DIRTY]


MALFORMED = ['{"a":[{"b":1]}}', '{"a" {"b":1}}', '{"a":1,}', "[}", "{]", '{"a":nul}', '{"a":01}', '{"a":1.}', "[1,]", "[,1]", "[1 2]", '{"a":1 "b":2}', '{"a","b"}', '{"a":}', '{:1}', '{1:2}', '["a" "b"]', '["a":1]', '{"a":"b":1}', '["\\q"]', '["\\u12g4"]', '["a\nb"]', "x{}", "{}x", "{},", ",{}", '{"a":[1,{"b":2}}]', "[[],,[]]", "[true false]", '{"a"}', "[-]", "[1e]", "[+1]", '{"a":1,{"b":2}}', "[{}{}]", "[]]", '{"a":"b","c"}', '"{\\"a\\":1,}"', "[NaN,-Infinity,1e5,-0.5E-3]", '["\\u00e9\\/"]', '{"a":\t[ ] , "b" : { } }']


def test_malformed_records_are_judged_like_a_parser_does():
    got, readable = kernel(MALFORMED + DIRTY)
    assert readable == [read_json(t) is not None for t in MALFORMED + DIRTY]
    assert got == sorted([(i, *o) for i, t in enumerate(MALFORMED + DIRTY) for o in brute(t)], key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='{}[]:,"\\ 1atruenul', max_size=14), min_size=1, max_size=6))
def test_any_text_is_judged_like_a_parser_does(texts):
    assert kernel(texts)[1] == [read_json(t) is not None for t in texts]


leaf = st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=6)
tree = st.recursive(leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from([*CHILD_KEYS, "value", "x", 'q"{']), x, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(tree, min_size=1, max_size=5), st.booleans())
def test_any_json_matches_a_parser(values, pretty):
    texts = [json.dumps(v, ensure_ascii=pretty, indent=1 if pretty else None) for v in values]
    got, _ = kernel(texts, ("value",))
    assert got == sorted([(i, *o) for i, t in enumerate(texts) for o in brute(t, ("value",))], key=repr)


def test_cut_off_records_are_unreadable():
    whole = json.dumps({"children": [{"value": 'a"\\b'}, {"children": []}]})
    _, readable = kernel([whole[:i] for i in range(1, len(whole))] + [whole])
    assert readable == [False] * (len(whole) - 1) + [True]


def test_very_deep_and_very_long():
    deep = '{"children":[' * 3000 + "]}" * 3000
    long = json.dumps({"value": "x" * 3_000_000, "children": [{}]})
    got, readable = kernel([deep, long])
    assert readable == [True, True] and len(got) == 3002
    assert max(g[1] for g in got if g[0] == 0) == 2999


def test_spark_operator_with_clashing_and_null_columns(spark):
    df = spark.createDataFrame([(1, "x", '{"title":"t","children":{"title":"u","path":"p"}}', "o"), (None, None, '[{"title":null}]', None), (2, "y", None, "z")], "docset_id long, obj_no string, toc string, title string")
    got = rows(flatten_json(df, "toc", {"docset_id": "long"}, fields=TOC_FIELDS, with_key=True))
    assert got == sorted([(1, 0, -1, None, "t", None, None), (1, 1, 0, "children", "u", "p", None), (None, 0, -1, None, None, None, None)], key=repr)
    assert rows(flatten_json(df.limit(0), "toc", {"docset_id": "long"})) == []


def test_all_tables(spark, data):
    from docquarry.queries import QUERIES

    exp = []
    for kind, table, key, col in (("page", "stored_pages", "page_id", "body"), ("toc", "docsets", "docset_id", "toc")):
        t = pq.read_table(f"{data}/{table}.parquet")
        exp += [(kind, i, *o) for i, b in zip(t.column(key).to_pylist(), t.column(col).to_pylist()) for o in brute(b)]
    assert rows(QUERIES["p2_found"](spark, data)) == sorted(exp, key=repr)
