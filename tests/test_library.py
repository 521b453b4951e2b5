import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from docquarry import library_queries, queries  # noqa: F401 - the first registers its queries
from docquarry.operators import catalog, evaluation, graph, index, reconcile, search
from docquarry.plans import crawl, ingest
from docquarry.plans.library import Library, remove_source
from docquarry.sources import addresses, config, fetch, man, robots, store
from docquarry.sources.datasource import register
from docquarry.streaming.ingest import deduplicated, reconcile_stream, windowed_counts
from tests.conftest import rows


def page(*texts, head=None, code=None):
    kids = [{"type": "heading", "level": 1, "id": None, "children": [{"type": "text", "value": head}]}] if head else []
    kids += [{"type": "paragraph", "children": [{"type": "text", "value": t}]} for t in texts]
    kids += [{"type": "code_block", "language": None, "code": code}] if code else []
    return json.dumps({"type": "document", "children": kids})


@pytest.fixture(scope="module")
def lib(spark):
    pages = spark.createDataFrame(
        [
            ("cargo", "manifest.html", "The Manifest Format", page("the manifest file describes a package", head="Manifest"), "h1", 0),
            ("cargo", "build.html", "Build Scripts", page("a build script runs before the package", "manifest"), "h2", 1),
            ("std", "struct.Vec.html", "Struct Vec", page("a growable array", head="pub fn push_back(x)", code="let v = Vec::new(); readToString()"), "h3", 0),
            ("std", "long.html", "Long", page("manifest " + "word " * 3000), "h4", 1),
            ("std", "broken.html", "Broken", '{"type":', "h5", 2),
        ],
        "source_id string, path string, title string, body string, content_hash string, ordinal int",
    )
    sources = spark.createDataFrame([("cargo", "Cargo Book", "tool"), ("std", "zStd", "lib"), ("empty", "apple", "lib")], "id string, name string, category string")
    return Library(spark, sources, pages)


def paths(df):
    return [r.path for r in df.orderBy("hit_rank").collect()]


def test_search_ranks_headings_first_and_scopes(lib):
    assert paths(lib.search("manifest"))[0] == "manifest.html"
    assert paths(lib.search("manifest", source="std")) == ["long.html"]
    assert [r.source_name for r in lib.search("growable").collect()] == ["zStd"]


def test_long_pages_are_penalised(spark):
    df = spark.createDataFrame([(8.0, 4000), (8.0, 8000), (8.0, 0)], "s double, n int")
    got = [round(r[0], 4) for r in df.select(search.length_penalty(F.col("s"), F.col("n"), 4000, 1.6)).collect()]
    assert got == [8.0, round(8 / (1 + 1.6 * math.log(2)), 4), 8.0]


def test_phrases_need_adjacent_words(lib):
    assert paths(lib.search('"manifest file"')) == ["manifest.html"]
    assert paths(lib.search('"file manifest"')) == []


def test_symbols_and_code(lib):
    assert paths(lib.search("@push_back")) == ["struct.Vec.html"]
    assert paths(lib.lookup_symbol("vec")) == ["struct.Vec.html"]
    assert paths(lib.search("read to string"))[:1] == ["struct.Vec.html"]


def test_correction(lib):
    assert [tuple(r) for r in lib.suggest("manifset").collect()] == [("manifset", "manifest")]
    assert "manifest.html" in paths(lib.search("manifset"))
    assert lib.suggest("manifest").collect() == [] and lib.suggest("xyzzyq").collect() == []


@pytest.mark.parametrize("q", ["", "   ", None, "@", '"', "+-!()", "how do I"])
def test_odd_queries_don_t_fail(lib, q):
    lib.search(q).collect()


def test_snippets_and_views(lib):
    got = [r for r in lib.snippets("manifest package").collect() if r.path == "manifest.html"]
    assert any(r.matched and r.text == "manifest" for r in got)
    assert [r.id for r in lib.list_sources().collect()] == ["empty", "cargo", "std"]
    assert rows(lib.page_markdown("cargo", "build.html"))[0][2].startswith("a build script")
    assert lib.outline("cargo", "manifest.html").count() == 1 and lib.pages("std", 1, 1).count() == 1


def test_index_round_trip(lib, spark, tmp_path):
    lib.index.save(str(tmp_path))
    again = Library(spark, lib.sources, lib.stored, index.Index.load(spark, str(tmp_path)))
    assert rows(again.search("manifest package")) == rows(lib.search("manifest package"))
    assert rows(search.total_hits(again.index, spark.createDataFrame([(1, "manifest")], "query_id long, q string"))) == [(1, 3, False)]


def test_empty_index(spark):
    none = spark.createDataFrame([], "source_id string, path string, title string, body string")
    ix = ingest.index_of(none)
    assert search.search(ix, spark.createDataFrame([(1, "x")], "query_id long, q string")).collect() == []


def test_reconcile(spark):
    a = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", None, "1"), ("s", "n", None)], "source_id string, path string, content_hash string")
    b = spark.createDataFrame([("s", "b", "9"), ("s", "c", "3"), ("s", None, "1"), ("s", "n", None)], "source_id string, path string, content_hash string")
    changes = reconcile.diff(a, b)
    assert rows(changes) == sorted([("s", "a", "add"), ("s", "b", "update"), ("s", "c", "remove"), ("s", None, "keep"), ("s", "n", "keep")], key=repr)
    assert reconcile.has_work(changes) and not reconcile.has_work(reconcile.diff(a, a))
    assert rows(reconcile.missing(b, a).select("path")) == [("c",), (None,)]
    for outcome, n in ((reconcile.CrawlOutcome(0), 4), (reconcile.CrawlOutcome(3, 1), 4), (reconcile.CrawlOutcome(3, 0, True), 4), (reconcile.CrawlOutcome(3), 2)):
        assert reconcile.prune_missing(b, a, outcome).count() == n
    up = reconcile.upsert(a.where("path is not null"), spark.createDataFrame([("s", "a", "7", 1), ("s", "a", "8", 2), ("t", "z", "0", 0)], "source_id string, path string, content_hash string, o int"), ["source_id", "path"], ["o"])
    assert ("s", "a", "8") in rows(up) and ("t", "z", "0") in rows(up) and up.count() == 4
    s, p = reconcile.delete_source(spark.createDataFrame([("s",), ("t",)], "id string"), a, "s")
    assert rows(s) == [("t",)] and rows(p) == []
    log = spark.createDataFrame([("a", 200, False), ("a", 404, False), ("b", 200, False), ("b", 500, False), ("c", 200, True), ("d", 404, None), ("e", None, None)], "source_id string, status int, capped boolean")
    assert rows(reconcile.safe_to_prune(log)) == [("a", True), ("b", False), ("c", False), ("d", False), ("e", False)]


@pytest.mark.parametrize(
    "sync, last, trigger, out",
    [
        ({"strategy": {"strategy": "manual"}, "pin_version": True}, None, "launch", "pinned"),
        ({"strategy": {"strategy": "manual"}}, None, "launch", "only_manually"),
        ({"strategy": {"strategy": "on_launch"}}, None, "launch", "now"),
        ({"strategy": {"strategy": "on_launch"}}, None, "tick", "not_yet"),
        ({"strategy": {"strategy": "scheduled", "schedule": "daily"}}, "2025-01-09 12:00:00", "tick", "now"),
        ({"strategy": {"strategy": "scheduled", "schedule": "daily"}}, "2025-01-09 12:00:01", "tick", "not_yet"),
        ({"strategy": {"strategy": "scheduled", "schedule": "monthly"}}, None, "tick", "now"),
        ({"strategy": {"strategy": "watch"}}, None, "tick", "watch_undecided"),
    ],
)
def test_sync_due(spark, sync, last, trigger, out):
    df = spark.createDataFrame([(json.dumps(sync), last)], "sync string, last string")
    assert df.select(reconcile.sync_due(F.col("sync"), F.col("last").cast("timestamp"), trigger, F.lit("2025-01-10 12:00:00").cast("timestamp"))).first()[0] == out


def test_evaluation(spark):
    ranks = spark.createDataFrame([(1, 1, "a"), (2, 0, "a"), (3, 2, "b"), (4, 5, "b")], "query_id long, rank int, kind string")
    m = {r.kind: (r.n, round(r.mrr, 4), r.recall_at_3) for r in evaluation.metrics(ranks, "kind").collect()}
    assert m == {"a": (2, 0.5, 0.5), "b": (2, 0.35, 0.5), None: (4, 0.425, 0.5)}
    new = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (5, 1)], "query_id long, rank int")
    assert {r.query_id: r.moved for r in evaluation.movement(ranks, new).collect()} == {1: "worse", 2: "better", 3: "same", 4: "dropped", 5: "added"}
    assert evaluation.gate(ranks, ranks).first().passes and not evaluation.gate(ranks.limit(0), ranks.limit(0)).first().passes
    v = spark.createDataFrame([("x", float(i)) for i in range(1, 11)] + [("y", None), ("z", 3.0)], "k string, v double")
    assert rows(evaluation.nearest_rank(v, "v", "k", [0.5, 0.95])) == [("x", 5.0, 10.0), ("z", 3.0, 3.0)]
    g = evaluation.golden(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, value string"), spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "name string, value string"))
    assert rows(g) == [("a", "pass"), ("b", "mismatch"), ("c", "missing"), ("d", "orphan")] and not evaluation.golden_passes(g) and not evaluation.golden_passes(g.limit(0))
    d = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.9), ("b", "b", 0.1)], "e string, p string, c double")
    assert evaluation.accuracy(d, "e", "p", "c", 0.8).first().confident_errors == 1
    assert rows(evaluation.confusion(d, "e", "p", ["a", "b"])) == [("a", 1, 1), ("b", 0, 1)]
    best, value = evaluation.coordinate_descent({"x": 0, "y": 0}, {"x": [0, 1, 2, 3], "y": [0, 5]}, lambda p: -((p["x"] - 2) ** 2) - (p["y"] - 5) ** 2)
    assert best == {"x": 2, "y": 5} and value == 0


def test_crawl_matches_brute_force(spark):
    import random

    r = random.Random(5)
    e = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(70)] + [(None, "n1"), ("n1", None)]
    depth, front = {"n0": 1}, ["n0"]
    while front:
        front = [d for s, d in e if s in front and s is not None and d is not None and d not in depth and not depth.update({d: depth[s] + 1})]
    edges, start = spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame([("n0",)], "node string")
    got, capped = graph.crawl(edges, start, 5)
    assert {(x.node, x.depth) for x in got.collect()} == {(n, d) for n, d in depth.items() if d <= 5} and not capped
    got, capped = graph.crawl(edges, start, 50, max_pages=3)
    assert got.count() == 3 and capped


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: docquarry\nUser-agent: other\nDisallow: /private\nAllow: /private/ok # yes\nDisallow: /*.pdf$\nDisallow: /a*b\nCrawl-delay: 900\n"
    r = robots.parse(text)
    assert r.delay == 60.0
    assert [r.allows(p) for p in ("/", "/private/x", "/private/ok/1", "/x.pdf", "/x.pdf?y", "/axbyyy", "/robots.txt")] == [True, False, True, False, True, False, True]
    assert not robots.parse("User-agent: *\nDisallow: /").allows("/x") and robots.parse("").allows("/x")
    assert robots.of_response(404, None).allows("/x") and not robots.of_response(503, None).allows("/x") and not robots.of_response(None, None).allows("/x")
    urls = spark.createDataFrame([("h", "/private/x"), ("h", None), ("g", "/x"), ("i", "/x")], "host string, path string")
    got = robots.verdicts(urls, spark.createDataFrame([("h", 200, text), ("g", 404, None)], "host string, status int, text string"))
    assert rows(got) == [("g", "/x", True), ("h", "/", True), ("h", "/private/x", False), ("i", "/x", False)]


@pytest.mark.parametrize(
    "a, kind",
    [("8.8.8.8", "public"), ("127.0.0.1", "private"), ("10.1.2.3", "private"), ("169.254.169.254", "forbidden"), ("0.0.0.0", "forbidden"), ("::1", "private"), ("::ffff:127.0.0.1", "private"), ("::ffff:8.8.8.8", "public"), ("64:ff9b::a9fe:a9fe", "forbidden"), ("2002:7f00:1::", "private"), ("fe80::1", "forbidden"), ("fd00::1", "private"), ("2606:4700::1", "public"), ("2001:db8::1", "forbidden"), ("4000::1", "forbidden"), ("x", "forbidden"), ("", "forbidden")],
)
def test_addresses(a, kind):
    assert addresses.classify(a) == kind


HEAD = "schema_version: 1\nname: X\n"


def test_configs(spark, tmp_path):
    good = HEAD + """category: a
version: "3"
source:
  type: generic
  url: https://x.org/
  generic: {max_depth: 2, content_selector: "div#c", include_patterns: ["^/a"], entry_points: [/start]}
fetch: {rate_limit_rps: 9, timeout_seconds: 5, respect_robots: false}
display: {icon: 🦀, accent_color: "#5e6ad2"}
attribution: {homepage: "https://x.org/", licence: MIT}
sync: {strategy: scheduled, schedule: weekly}
enrich: {tldr_summaries: true}
"""
    c = config.parse("x", good)
    assert (c.max_depth, c.max_pages, c.fetch.rate, c.icon, c.include, c.entry_points) == (2, 5000, 4.0, ("emoji", "🦀"), ("^/a",), ("/start",))
    assert (c.version, c.licence, c.fetch.respect_robots, c.fetch.timeout, c.sync.schedule) == ("3", "MIT", False, 5, "weekly")
    assert config.parse("m", HEAD + "source: {type: man, man: {paths: [/usr/share/man]}}").man_sections == tuple(range(1, 9))
    assert config.parse("h", HEAD + "source: {type: rustdoc, url: 'http://x'}\nfetch: {allow_insecure: true}").category == config.CATEGORY
    man = "source: {type: man, man: {paths: [a]}}\n"
    bad = ["source: {type: nope}", "x: 1", "source: {type: rustdoc, url: 'http://x'}", "source: {type: rustdoc, url: x}", "source: {type: rustdoc, url: 'https://x', generic: {}}", "source: {type: generic, url: 'https://x', generic: {include_patterns: ['(']}}"]
    bad += ["source: {type: generic, url: 'https://x', generic: {max_depth: 0}}", "source: {type: generic, url: 'https://x', generic: {nav_selector: '>>'}}", "source: {type: man}", "source: {type: man, man: {paths: []}}", "source: {type: man, man: {paths: [a], sections: [9]}}", "source: {type: local}", "source: {type: local, path: a, url: 'https://x'}"]
    bad += [man + x for x in ("sync: {strategy: watch}", "sync: {strategy: scheduled}", "sync: {schedule: daily}", "sync: {strategy: scheduled, schedule: hourly}", "display: {accent_color: red}", "odd: 1", "fetch: {rate_limit_rps: 0}", "fetch: {timeout_seconds: 0}", "fetch: {rate: 1}", "fetch: {respect_robots: 1}", "attribution: {homepage: x}")]
    for text in [HEAD + x for x in bad] + ["[", "1", "name: X\n" + man, "schema_version: 2\nname: X\n" + man, "schema_version: 1\nname: ' '\n" + man]:
        with pytest.raises(config.ConfigError):
            config.parse("x", text)
    with pytest.raises(config.ConfigError):
        config.parse("bad id", good)
    (tmp_path / "b.yaml").write_text(good)
    (tmp_path / "a.yaml").write_text(HEAD + man)
    (tmp_path / "c.yaml").write_text("source: 1")
    found, warnings = config.scan(str(tmp_path))
    assert [s.id for s in found] == ["a", "b"] and len(warnings) == 1 and config.to_frame(spark, found).count() == 2
    assert config.registry("sources: [{id: a, name: A, config: c/a.yaml}]")[0]["config"] == "c/a.yaml"
    with pytest.raises(config.ConfigError):
        config.registry("sources: [{id: a, config: ../x}]")


def test_fetch_retries_and_limits():
    answers, waits = [], []
    ok = fetch.Response(200, {}, b"x" * 10)

    def play(script):
        answers[:], waits[:] = list(script), []
        return fetch.fetch("https://x/", lambda *a: answers.pop(0), most=10, sleep=waits.append)

    assert play([fetch.Response(500, {}, b""), fetch.Response(None, {}, b"", "down"), ok]).status == 200 and [round(w, 1) for w in waits] == pytest.approx([0.5, 1.0], abs=0.11)
    assert play([fetch.Response(404, {}, b"")]).status == 404 and not waits
    assert play([fetch.Response(429, {"retry-after": "7"}, b""), ok]).status == 200 and waits[0] >= 7
    assert play([fetch.Response(503, {}, b"")] * 4).status == 503 and len(waits) == 3
    assert play([fetch.Response(200, {}, b"x" * 11)]).error and fetch.gap(9, None) == 0.25 and fetch.gap(2, 5.0) == 5.0


def test_fetch_pages(spark):
    def web(url, headers, timeout, most):
        if url.endswith("robots.txt"):
            return fetch.Response(200, {}, b"User-agent: *\nDisallow: /no")
        if "missing" in url:
            return fetch.Response(404, {}, b"")
        return fetch.Response(200, {"content-type": "image/png" if "img" in url else "text/html", "etag": "e"}, url.encode())

    urls = spark.createDataFrame([("https://x/a",), ("https://x/a",), ("https://x/no",), ("https://y/missing",), ("https://y/img",), (None,)], "url string")
    got = fetch.fetch_pages(urls, rate=4.0, transport=web)
    assert got.count() == 4 and rows(fetch.usable(got).select("url")) == [("https://x/a",)]
    assert rows(fetch.failures(got).select("url")) == [("https://x/no",), ("https://y/missing",)]


def test_man_pages(spark, tmp_path):
    import gzip

    (tmp_path / "man1").mkdir()
    (tmp_path / "man1" / "ls.1").write_text("ls")
    (tmp_path / "man1" / "cp.1.gz").write_bytes(gzip.compress(b"cp"))
    (tmp_path / "man1" / "notes.txt").write_text("x")
    assert [(s, n) for s, n, _ in man.discover([str(tmp_path)])] == [(1, "cp"), (1, "ls")] and man.discover([str(tmp_path)], [3]) == []

    def draw(raw):
        if raw == b"cp":
            raise ValueError("bad")
        return '<a class="Xr">cp(1)</a><a class="Xr">mv(1)</a>'

    got = {r.name: r for r in man.pages(spark, [str(tmp_path)], render=draw).collect()}
    assert got["ls"].html == '<a class="Xr" href="cp.1.html">cp(1)</a><a class="Xr">mv(1)</a>' and got["cp"].error == "bad"


def test_store_and_files(spark, tmp_path):
    s = store.PageStore(spark, str(tmp_path / "s"))
    shape = "source_id string, path string, body string"
    s.write(spark.createDataFrame([("a", "1", "x"), ("b", "1", "x")], shape))
    s.write(spark.createDataFrame([("a", "2", "y")], shape))
    assert rows(s.read().select("source_id", "path")) == [("a", "2"), ("b", "1")] and s.page("b", "1").count() == 1
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / store.page_file_name("p")).write_text(json.dumps({"path": "p", "title": "T", "description": None, "body": {"type": "document", "children": []}}))
    (folder / "bad.json").write_text("{")
    assert rows(store.read_page_files(spark, str(folder)).select("path", "title")) == [("p", "T")]
    register(spark)
    (folder / "none.json").write_text("[]")
    read = spark.read.format("docpages").load(str(folder))
    assert rows(read.where("error is null").select("path", "body")) == [("p", '{"type": "document", "children": []}')]
    assert sorted(r.error.split(":")[0] for r in read.where("error is not null").collect()) == ["no page", "unreadable"]
    assert s.remove("a") and not s.remove("a") and rows(s.read().select("source_id")) == [("b",)]
    assert rows(store.to_json_lines(spark.createDataFrame([(1, None)], "a int, b string"))) == [('{"a":1,"b":null}',)]


def test_assets(spark):
    rows_ = [("s", "u1", "image/png; x", b"aa", 1), ("s", "u1", "image/png", b"zz", 2), ("s", "u2", "image/PNG", b"aa", 3), ("s", "u3", "text/html", b"a", 4), ("s", "u4", "image/gif", b"a" * 50, 5), ("s", "u5", "image/gif", None, 6), ("s", "u6", "image/gif", b"bbb", 7)]
    got = {r.url: (r.kept, r.error, r.name) for r in store.assets(spark.createDataFrame(rows_, "source_id string, url string, content_type string, body binary, ord int"), most=40, budget=4).collect()}
    assert got["u1"][0] and got["u1"][2] == got["u2"][2] and got["u1"][2].endswith(".png")
    assert [got[u][1] for u in ("u3", "u4", "u5", "u6")] == ["unsupported type", "too large", "no body", "over the budget"]


def test_pull(spark):
    shape = "source_id string, url string, html string, fetched_at timestamp, ordinal int"
    t = dt.datetime(2025, 1, 1)
    site = [("s", "https://x.org/a.html", "<main><h1>A</h1><a href='b.html#f'>b</a><a href='c.html'>c</a></main>", t, 0), ("s", "https://x.org/b.html", "<main><h1>B</h1></main>", t, 1), ("s", "https://x.org/b.html?x", "<main><h1>B2</h1></main>", t, 2)]
    first = ingest.process(spark.createDataFrame(site, shape))
    got = {r.path: r for r in first.collect()}
    links = [n["href"] for n in json.loads(got["a.html"].body)["children"] if n["type"] == "link"]
    assert links == ["b.html#f", "https://x.org/c.html"] and got["b.html"].title == "B2"
    later = spark.createDataFrame([("s", "https://x.org/a.html", "<main><h1>A!</h1></main>", t, 0)], shape)
    done = ingest.pull(first, later, reconcile.CrawlOutcome(1))
    assert rows(done.changes) == [("s", "a.html", "update"), ("s", "b.html", "remove")] and done.pages.count() == 1
    kept = ingest.pull(first, later, reconcile.CrawlOutcome(1, ambiguous_errors=1))
    assert rows(kept.changes) == [("s", "a.html", "update"), ("s", "b.html", "keep")]


def test_pulled_pages_hold_no_remote_images(spark):
    shape = "source_id string, url string, html string, fetched_at timestamp, ordinal int"
    site = [("s", "https://x.org/g/a.html", "<main><h1>A</h1><img src='i.png' alt=I><img src='https://y.org/j.png' alt=J><a href='b.html'>b</a></main>", None, 0), ("s", "https://x.org/g/b.html", "<main><h1>B</h1></main>", None, 1), ("t", "https://t.org/a.html", "<main><img src='https://x.org/g/i.png'></main>", None, 0)]
    fetched = spark.createDataFrame(site, shape)
    images = [("s", "https://x.org/g/i.png", "image/png", b"aa", 1), ("s", "https://y.org/j.png", "text/html", b"x", 2)]
    manifest = store.assets(spark.createDataFrame(images, "source_id string, url string, content_type string, body binary, ord int"))
    name = manifest.where("kept").first().name
    old = spark.createDataFrame([], "source_id string, path string, title string, description string, body string, content_hash string, fetched_at timestamp, ordinal int")
    got = {r.source_id + r.path: r.body for r in ingest.pull(old, fetched, reconcile.CrawlOutcome(1), manifest=manifest).pages.collect()}
    assert f'"src": "{name}"' in got["sg/a.html"] and "image unavailable offline: J" in got["sg/a.html"] and '"href": "g/b.html"' in got["sg/a.html"]
    assert not any("x.org" in b or "y.org" in b for b in got.values()) and "unavailable" in got["ta.html"]
    bare = {r.source_id + r.path: r.body for r in ingest.process(fetched).collect()}
    assert bare["sg/a.html"].count("image unavailable offline") == 2 and '"src"' not in bare["sg/a.html"]


def test_snapshot_queries_follow_the_numbers_of_the_data(spark, tmp_path):
    shape = "snapshot_no int, source_id string, path string, content_hash string, fetched_at timestamp, ordinal int"
    t = dt.datetime(2025, 1, 1)
    made = [(2, "s", "x", "0", t, 0), (7, "s", "a", "1", t, 0), (7, "s", "b", "1", t, 1), (9, "s", "a", "2", t, 0), (9, "s", "c", "1", t, 1)]
    spark.createDataFrame(made, shape).write.parquet(f"{tmp_path}/pages.parquet")
    got = {q: rows(queries.QUERIES[q](spark, str(tmp_path))) for q in ("index_diff", "prune_missing", "upsert_pages", "golden_diff", "list_pages_ordered")}
    assert got["index_diff"] == [("s", "a", "update"), ("s", "b", "remove"), ("s", "c", "add")]
    assert [r[:2] for r in got["prune_missing"]] == [("s", "a")] and [r[:2] for r in got["upsert_pages"]] == [("s", "a"), ("s", "b"), ("s", "c")]
    assert got["golden_diff"] == [("s a", "mismatch"), ("s b", "orphan"), ("s c", "missing")]
    assert got["list_pages_ordered"] == [("s", "a", 0, 1), ("s", "c", 1, 2)]


def test_plain_queries_keep_quoted_items(spark, tmp_path):
    made = [(1, 'say "a b" AND c'), (2, 'odd " quote'), (3, "none"), (4, None)]
    spark.createDataFrame(made, "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert rows(queries.QUERIES["plain_text_query"](spark, str(tmp_path))) == [(1, 'say "a b" and c'), (2, "odd quote"), (3, "none"), (4, None)]


def test_streams(spark, tmp_path):
    shape = "source_id string, path string, content_hash string, fetched_at timestamp"
    t = dt.datetime(2025, 1, 1, 0, 5)
    spark.createDataFrame([("s", "a", "1", t), ("s", "b", "2", t)], shape).write.parquet(str(tmp_path / "in"))
    state, written = {"df": spark.createDataFrame([("s", "a", "0", t)], shape)}, []

    def write(df, number):
        state["df"] = df
        written.append(number)

    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    reconcile_stream(stream, lambda: state["df"], write, str(tmp_path / "ck")).awaitTermination()
    assert rows(state["df"].select("path", "content_hash")) == [("a", "1"), ("b", "2")] and len(written) == 1
    reconcile_stream(stream, lambda: state["df"], write, str(tmp_path / "ck2")).awaitTermination()
    assert len(written) == 1
    events = spark.createDataFrame([(t, "k", 1.0, 1), (t, "k", 2.0, 1), (dt.datetime(2025, 1, 1, 1, 0), "k", 4.0, 2)], "ts timestamp, k string, v double, id int")
    assert [(r.n, r.total) for r in windowed_counts(events, "ts", "k", "v").orderBy("window_start").collect()] == [(2, 3.0), (1, 4.0)]
    events.write.parquet(str(tmp_path / "ev"))
    q = deduplicated(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "ts", "id").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def test_catalog(spark):
    s = spark.createDataFrame([("b", "Zed", "https://x/", "l"), ("a", "alpha", None, "l"), ("c", "Beta", "https://y", "m")], "id string, name string, url string, category string")
    assert [r.id for r in catalog.list_sources(s).collect()] == ["a", "c", "b"] and [r.id for r in catalog.list_sources(s, "m").collect()] == ["c"]
    new = spark.createDataFrame([("n", "N", "https://x", "l"), ("a", "A", None, "l"), ("m", "M", "https://z", "l")], s.schema)
    assert rows(catalog.duplicates(s, new).select("id")) == [("a",), ("n",)]
    p = spark.createDataFrame([("a", f"{i}", i) for i in range(30)], "source_id string, path string, ordinal int")
    assert [r.ordinal for r in catalog.paged(p, 28, 5).collect()] == [28, 29] and catalog.paged(p, -1, 0).count() == 1
    assert rows(catalog.sources_with_counts(s, p).select("id", "n_pages")) == [("a", 30), ("b", 0), ("c", 0)]
    assert rows(catalog.never_pulled(s, p).select("id")) == [("b",), ("c",)]


def _small_index(spark, data):
    docs = spark.createDataFrame(data, "source_id string, path string, text string")
    return index.build(docs, ["source_id", "path"], {"body": index.placed_tokens(F.col("text"))}, {"body_chars": F.length("text")})


def test_commits_replace_and_delete(spark, tmp_path):
    at, body_only = str(tmp_path / "i"), search.Ranking({"body": 1.0}, max_distance=0)
    asked = spark.createDataFrame([(1, "apple")], "query_id long, q string")

    def found():
        now = index.load_segments(spark, at)
        hits = search.search(now, asked, 10, body_only)
        return [(r.source_id, r.path) for r in hits.orderBy("hit_rank").collect()], now.docs.count(), now.stats.first().n_docs

    assert index.commit(at, _small_index(spark, [("s", "a", "apple pie"), ("s", "b", "pear"), ("t", "c", "apple")])) == 1
    assert found() == ([("t", "c"), ("s", "a")], 3, 3)
    index.commit(at, _small_index(spark, [("s", "b", "apple apple"), ("s", "a", "plum")]))
    assert found() == ([("s", "b"), ("t", "c")], 3, 3)
    index.commit(at, deleted=spark.createDataFrame([("s", "b")], "source_id string, path string"))
    assert found() == ([("t", "c")], 2, 2)
    index.commit(at, deleted=spark.createDataFrame([("t",)], "source_id string"))
    assert found() == ([], 1, 1)
    index.commit(at, _small_index(spark, [("t", "c", "apple")]))
    assert found() == ([("t", "c")], 2, 2)
    (tmp_path / "i" / "docs" / "segment=9").mkdir()  # a commit that died is not read
    assert found()[1] == 2


def test_totals_and_truncation(spark):
    built = _small_index(spark, [("s", str(i), "apple pie" if i % 2 else "apple tart") for i in range(9)])
    asked = spark.createDataFrame([(1, "apple"), (2, '"apple pie"'), (3, "zebra")], "query_id long, q string")
    only = search.Ranking({"body": 1.0}, max_distance=0)
    assert rows(search.total_hits(built, asked, ranking=only)) == [(1, 9, False), (2, 4, False)]
    assert rows(search.total_hits(built, asked, 5, only, F.col("path") < "4")) == [(1, 4, False), (2, 2, False)]
    hits = search.with_totals(search.search(built, asked, 4, only), search.total_hits(built, asked, ranking=only))
    assert {(r.query_id, r.total, r.truncated) for r in hits.collect()} == {(1, 9, True), (2, 4, False)}


def test_crawl_site(spark):
    site = {
        "/": "<a href='a'>a</a><a href='b#x'>b</a><a href='https://other.org/'>o</a><a href='no/1'>n</a>",
        "/a": "<a href='c'>c</a><a href='/'>home</a><a href='gone'>g</a>", "/b": "<a href='a'>a</a>", "/c": "<a href='d'>d</a>", "/d": "end", "/start": "<a href='b'>b</a>",
    }

    def play(url, headers, timeout, most):
        path = "/" + url.split("/", 3)[3]
        page = site.get(path)
        return fetch.Response(404, {}, b"") if page is None else fetch.Response(200, {"content-type": "text/html"}, f"<main>{page}</main>".encode())

    def got(**kw):
        s = config.Source("x", "X", "generic", url="https://x.org/", exclude=("^/no/",), fetch=config.Fetch(rate=1e9, respect_robots=False), **kw)
        c = crawl.crawl_site(spark, s, play)
        return {(r.url.removeprefix("https://x.org"), r.depth) for r in c.pages.collect()}, rows(c.failed.select("url", "status")), c.outcome

    pages, failed, outcome = got(max_depth=3, entry_points=("start", "start#y", "mailto:a@b"))
    assert pages == {("/", 1), ("/start", 1), ("/a", 2), ("/b", 2), ("/c", 3)} and failed == [("https://x.org/gone", 404)]
    assert outcome.safe_to_prune and outcome.produced == 5
    pages, _, outcome = got(max_depth=4, max_pages=2)
    assert pages == {("/", 1), ("/a", 2)} and outcome.capped and not outcome.safe_to_prune
    site.clear()
    pages, _, outcome = got()
    assert not pages and not outcome.safe_to_prune


def test_remove_source(spark, tmp_path):
    held = store.PageStore(spark, str(tmp_path / "p"))
    held.write(spark.createDataFrame([("s", "a", "x"), ("t", "a", "x")], "source_id string, path string, body string"))
    index.commit(str(tmp_path / "i"), _small_index(spark, [("s", "a", "apple"), ("t", "a", "apple")]))
    (tmp_path / "s.yaml").write_text("x")
    sources = spark.createDataFrame([("s",), ("t",)], "id string")
    for _ in range(2):
        left = remove_source(spark, "s", str(tmp_path / "i"), held, sources, str(tmp_path / "c"), str(tmp_path / "s.yaml"))
    assert rows(left) == rows(spark.read.parquet(str(tmp_path / "c"))) == [("t",)] and not (tmp_path / "s.yaml").exists()
    assert rows(held.read().select("source_id")) == [("t",)] and rows(index.load_segments(spark, str(tmp_path / "i")).docs.select("source_id")) == [("t",)]


def test_small_views(spark):
    got, kept = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, value string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "name string, value string")
    assert rows(evaluation.golden(got, kept, update=True)) == [("a", "pass"), ("b", "updated"), ("c", "orphan")]
    p = spark.createDataFrame([("s", i, str(i)) for i in range(7)], "source_id string, ordinal int, path string")
    assert [(r.ordinal, r.total) for r in catalog.paged_with_total(p, 5, 5).collect()] == [(5, 7), (6, 7)]
    assert catalog.source_exists(p.withColumnRenamed("source_id", "id"), "s") and not catalog.source_exists(p.withColumnRenamed("source_id", "id"), "x")


def test_equal_documents_are_ranked_by_key(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta " + "epsilon " * (i % 3)) for i in range(90)], "doc_id long, text string").repartition(7)
    built = index.build(docs, ["doc_id"], {"body": index.placed_tokens(F.col("text"))}, {"body_chars": F.length("text")})
    asked = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "query_id long, q string")
    for _ in range(3):
        got = search.search(built, asked, 40, search.Ranking({"body": 1.0}, max_distance=0)).orderBy("hit_rank").collect()
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (-next(x.score for x in got if x.doc_id == i), i))
        assert len({r.score for r in got}) == 2


def test_registered_queries_agree_with_sql(spark, data):
    import os

    import duckdb

    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(data):
        con.sql(f"create view {f[:-8]} as select * from '{data}/{f}'")

    def plain(v):
        return repr(round(v, 6)) if isinstance(v, float) else str(v.replace(tzinfo=None)) if isinstance(v, dt.datetime) else str(v)

    for name in ("p5_found", "p6_found", "p6_field_changes", "url_to_page_path", "index_diff", "sync_due", "mrr_recall_by_kind", "bm25_topk"):
        got = entry.queries()[name](spark, data)
        cols = sorted(got.columns)
        want = con.sql(entry.oracle_sql()[name])
        at = [list(want.columns).index(c) for c in cols]
        assert sorted([plain(v) for v in r] for r in got.select(*cols).collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall()), name
