import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.model import fields, render
from docquarry.model.ast import text_content
from docquarry.model.parse import parse_page
from docquarry.model.transform import localize, normalize, relink, sanitize, word_cut
from docquarry.operators import pages
from docquarry.functions.urls import page_path_of
from tests.conftest import rows

BASE = "https://x.org/guide/a.html"


def kids(html, **kw):
    return parse_page(html, BASE, **kw)["body"]["children"]


def text(s):
    return {"type": "text", "value": s}


def test_roots_titles_and_links():
    p = parse_page("<title> T\n x </title><nav><a href=/n>n</a></nav><main><h1>H</h1><a href='b.html#f'>b</a></main><p>out</p>", BASE)
    assert p["title"] == "T x" and p["links"] == ["https://x.org/n", "https://x.org/guide/b.html"]
    assert [n["type"] for n in p["body"]["children"]] == ["heading", "link"]
    assert parse_page("<body><h1>Only</h1></body>", BASE)["title"] == "Only"
    assert parse_page(None, BASE) == {"title": None, "body": {"type": "document", "children": []}, "links": []}
    assert kids("<div id=c><p>in</p></div><main>m</main>", selector="div#c") == [{"type": "paragraph", "children": [text("in")]}]
    assert kids("<main>m</main>", selector="p:hover") == [text("m")]


def test_blocks():
    html = """<main><h2 id=i>Name <a class=headerlink href=#i>¶</a></h2><pre class="highlight-python"><code>x = 1
</code></pre><dl><dt id=t>term</dt><dd>one</dd><dd>two</dd></dl>
<table><tr><th>a<th>b<tr><td>1<td>2</table><ol start=3><li>x<ul><li>y</ul></ol>
<div class="admonition warning"><p class=admonition-title>Careful</p><p>Hot</p></div><span id=s></span><hr><img src=i.png>
<section id=q><p>k <b>bold</b> <i>it</i></p></section><p hidden>no</p><div class="sr-only">no</div></main>"""
    got = kids(html)
    by = {n["type"]: n for n in got}
    assert by["heading"] == {"type": "heading", "level": 2, "id": "i", "children": [text("Name ")]} or by["heading"]["children"] == [text("Name")]
    assert by["code_block"] == {"type": "code_block", "language": "python", "code": "x = 1"}
    assert [(d["id"], d["term"], d["definition"]) for d in by["definition_list"]["items"]] == [("t", [text("term")], [text("one")]), (None, [], [text("two")])]
    assert [c["children"] for c in by["table"]["headers"]] == [[text("a")], [text("b")]] and len(by["table"]["rows"]) == 1
    assert by["list"]["start"] == 3 and by["list"]["items"][0]["children"][1]["type"] == "list"
    assert (by["admonition"]["kind"], by["admonition"]["title"]) == ("warning", "Careful")
    assert [n["id"] for n in got if n["type"] == "anchor"] == ["s", "q"]
    assert by["paragraph"]["children"] == [text("k "), {"type": "strong", "children": [text("bold")]}, text(" "), {"type": "emphasis", "children": [text("it")]}]


def test_unclosed_formatting_goes_on():
    assert kids("<main><p>a <b>b<p>c</main>") == [
        {"type": "paragraph", "children": [text("a "), {"type": "strong", "children": [text("b")]}]},
        {"type": "paragraph", "children": [{"type": "strong", "children": [text("c")]}]},
    ]


def test_profile_classes():
    assert kids("<main><div class='x HeaderLink'>no</div>yes</main>", drop_classes=frozenset(["headerlink"])) == [text("yes")]


def test_normalize():
    body = parse_page("<main><h3>Top</h3><p></p><p>Some words</p><h4><a href=b.html>x</a></h4><pre class=lang-py3>1</pre></main>", BASE)["body"]
    n = normalize(body, BASE)
    assert (n["title"], n["description"]) == ("Top", "Some words")
    assert [x.get("level") for x in n["body"]["children"]] == [1, None, 2, None]
    assert n["body"]["children"][2]["children"][0]["href"] == "https://x.org/guide/b.html"
    assert n["body"]["children"][3]["language"] == "python"
    assert word_cut("ab " * 100, 10) == "ab ab ab…"


def test_sanitize():
    doc = {"type": "document", "children": [
        {"type": "link", "href": "java\nscript:x", "title": None, "children": [text("t")]}, {"type": "link", "href": "#a b'c", "title": None, "children": []},
        {"type": "image", "src": "data:x", "alt": "A"}, {"type": "heading", "level": 1, "id": " ' ", "children": []}, {"type": "admonition", "kind": "W <", "title": None, "children": []}, {"type": "code_block", "language": "C++!", "code": ""}]}
    got = sanitize(doc)["children"]
    assert got == [text("t"), {"type": "link", "href": "#abc", "title": None, "children": []}, text("A"), {"type": "heading", "level": 1, "id": None, "children": []}, {"type": "admonition", "kind": "w", "title": None, "children": []}, {"type": "code_block", "language": "c", "code": ""}]


hostile = st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<table>", "<td>", "<a href='javascript:x'>", "<a href=#x id='\"y'>", "<li>", "<script>a</script>", "<h3>", "x", " ", "&amp;", "<div class=admonition>", "<!--", "-->", "<img src=data:x alt=q>", "</table>", "<pre>", "<dl><dt>", "<"]), max_size=25).map("".join)


@settings(max_examples=200, deadline=None)
@given(hostile)
def test_hostile_html(html):
    clean = sanitize(normalize(parse_page(html, BASE)["body"], BASE)["body"])
    assert sanitize(clean) == clean and json.loads(json.dumps(clean)) == clean
    out = render.to_html(clean)
    assert "<script" not in out and "javascript:" not in out.replace("&", "")
    render.to_markdown(clean), render.outline(clean), fields.search_fields(clean), fields.symbols("p", "t", clean), fields.snippet(clean, ["x"])


def test_localize_and_relink():
    doc = {"type": "document", "children": [{"type": "image", "src": "https://x/i.png", "alt": "I"}, {"type": "image", "src": "https://x/j.png", "alt": ""}, {"type": "link", "href": "https://x.org/guide/b.html#f", "title": None, "children": []}, {"type": "link", "href": "#z", "title": None, "children": []}, {"type": "link", "href": "https://x.org/c", "title": None, "children": []}]}
    got = relink(localize(doc, {"https://x/i.png": "assets/h.png"}), BASE, {"guide/b.html"}, page_path_of)["children"]
    assert got[0]["src"] == "assets/h.png" and got[1] == {"type": "emphasis", "children": [text("image unavailable offline")]}
    assert [n["href"] for n in got[2:]] == ["guide/b.html#f", "#z", "https://x.org/c"]


def test_symbols():
    h = lambda s: {"type": "heading", "level": 2, "id": None, "children": [text(s)]}
    doc = {"type": "document", "children": [h("pub const fn new() -> Self"), h("parse(x)"), h("Introduction"), h("class Foo.Bar"), h("const MAX: usize"), h("NEW")]}
    own, every = fields.symbols("std/vec/struct.Vec.html", "Struct Vec", doc)
    assert own == ("Vec", "type")
    assert every == [("Vec", "type"), ("new", "function"), ("parse", "function"), ("Foo.Bar", "type"), ("MAX", "constant")]


def test_snippet_marks_whole_words():
    doc = {"type": "document", "children": [{"type": "paragraph", "children": [text("manifests here")]}, {"type": "paragraph", "children": [text("word " * 30 + "the cargo manifest ends")]}]}
    got = fields.snippet(doc, ["cargo", "manifest"], 120)
    assert got[0][0].startswith("…") and [t for t, m in got if m] == ["cargo", "manifest"]
    assert fields.snippet(doc, ["absent"])[0] == ("manifests here", False) and fields.snippet({"type": "document", "children": []}, ["x"]) == []


def test_markdown_outline_sections():
    doc = parse_page("<main><h1 id=a>A</h1><p>x <code>y</code></p><h2 id=b>B</h2><ul><li>1<li>2</ul><h2>B</h2><h1 id=c>C</h1></main>", BASE)["body"]
    md = render.to_markdown(doc)
    assert "# A {#a}\n\nx `y`\n\n" in md and "- 1\n- 2\n" in md
    assert [(h["id"], h["parent"]) for h in render.outline(doc)] == [("a", -1), ("b", 0), ("b-2", 0), ("c", -1)]
    assert [n["type"] for n in render.section(doc, "b")] == ["heading", "list"] and render.section(doc, "nope") == []
    cut, was = render.cut_markdown("a\n\n```\nx\n\ny\n```\n", 12)
    assert was and cut.count("```") == 2


def test_highlight():
    from docquarry.model.highlight import highlight

    got = highlight("def f(x):\n    return '<'", "python")
    assert got.count('class="line"') == 2 and "&lt;" in got and 'class="k"' in got
    assert highlight("a < b\n", "nolanguage") == '<span class="line">a &lt; b</span>\n<span class="line"></span>'


def test_detection(spark):
    from docquarry.operators.detect import detect_pages

    df = spark.createDataFrame([("<LINK href=/Rustdoc-1.css>",), ("<div id=sidebar-scrollbox data-rustdoc>",), ("_static/x",), (None,)], "html string")
    assert [tuple(r) for r in detect_pages(df, []).collect()] == [("rustdoc", 0.97, "rustdoc", True), ("mdbook", 0.95, "mdbook", True), ("sphinx", 0.85, "readthedocs", True), ("generic", 0.4, "generic", False)]


def test_page_operators_on_messy_rows(spark):
    df = spark.createDataFrame([(1, '{"type":"document","children":[{"type":"paragraph","children":[{"type":"text","value":"the sorter"}]}]}', "p", None, "x"), (2, None, None, None, "x"), (3, '{"type":', "q", "t", "x"), (None, "[]", None, None, None)], "page_id long, body string, path string, title string, text string")
    keep = {"page_id": "long"}
    assert rows(pages.page_blocks(df, keep)) == [(1, 0, "the sorter")]
    assert [r[0] for r in rows(pages.page_fields(df, keep))] == [1]
    for op in (pages.page_markdown, pages.page_html, pages.page_outline, pages.page_sections, pages.page_symbols):
        op(df, keep).collect()
        assert op(df.limit(0), keep).collect() == []
    assert rows(pages.find_in_page(df, keep, "E S")) == [(1, 0, 2)]


def test_markdown_is_whole_unless_asked(spark):
    doc = {"type": "document", "children": [{"type": "paragraph", "children": [text(f"word {i} " * 10)]} for i in range(2000)]}
    df = spark.createDataFrame([(1, json.dumps(doc))], "page_id long, body string")
    whole, cut = (op(df, {"page_id": "long"}).first() for op in (pages.page_markdown, pages.page_markdown_cut))
    assert whole.markdown == render.to_markdown(doc) and not whole.truncated and "word 1999" in whole.markdown
    assert cut.truncated and len(cut.markdown.encode()) <= render.MARKDOWN_BYTES and whole.markdown.startswith(cut.markdown)


def test_parse_operator(spark):
    df = spark.createDataFrame([(1, "<main><h1>A</h1><a href=/b>b</a></main>", BASE), (2, None, None)], "raw_id long, html string, url string")
    got = rows(pages.parse_pages(df, {"raw_id": "long"}))
    assert got[0][1] == "A" and got[0][4] == ["https://x.org/b"] and json.loads(got[1][3]) == {"type": "document", "children": []}


@pytest.mark.parametrize("tag", ["div", "blockquote", "ul><li", "em", "table><tr><td", 'section class="admonition note"', "span", "a href=/x", "dl><dd"])
def test_deep_pages_keep_their_text(tag):
    n, names = 2000, [t.split()[0] for t in tag.split("><")]
    html = "<main><p>top</p>" + f"<{tag}>" * n + "deep text" + "".join(f"</{t}>" for t in reversed(names)) * n + "<p>after</p></main>"
    tree = json.loads(json.dumps(sanitize(normalize(parse_page(html, "https://x.org/")["body"], "https://x.org/")["body"])))
    said = text_content(tree)
    assert said.startswith("top") and "deep text" in said and said.endswith("after")
    assert "deep text" in render.to_html(tree) and "deep text" in render.to_markdown(tree) and fields.search_fields(tree)


def test_rows_of_inner_tables_stand_in_their_cell():
    tree = parse_page("<main><table><tr><td>a<table><tr><td>b</table><tr><td>c</table></main>", "https://x.org/")["body"]
    outer = tree["children"][0]
    assert [text_content(r) for r in outer["rows"]] == ["ab", "c"]
