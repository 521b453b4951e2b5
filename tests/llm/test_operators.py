"""The training-text operators against brute force, on small and messy tables."""

import collections
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions.words import letters, words
from docquarry.llm import components, leakage, nearduplicates, packing, repeatedlines, sitetemplates, subjects, vocabulary
from docquarry.llm.queries import P8_TOKENIZER, QUERIES, body_words
from tests.conftest import rows


def body(*lines):
    return json.dumps({"type": "document", "children": [{"type": "paragraph", "children": [{"type": "text", "value": x}]} for x in lines]})


# Repeated lines


def line_table(spark):
    r, data = random.Random(1), []
    for i in range(60):
        lines = [f"own line {chr(97 + i % 26)}{chr(97 + i // 26)} x", "", "123"]
        if i % 3 == 0:
            lines.append(f"Last updated on {i} March")
        if i < 6:
            lines.append("Rare but five")
        data.append((i, "s" if i < 50 else None, f"p{i // 2 if i > 55 else i}", body(*r.sample(lines, len(lines))), 1, 2))
    data += [(100 + i, "s", "p0", data[0][3], 1, 2) for i in range(20)] + [(200, "s", "q", None, 1, 2), (201, "s", "q", '{"type":', 1, 2), (None, "s", None, body("Last updated on"), 1, 2)]
    return data, spark.createDataFrame(data, "page_id long, source_id string, path string, body string, cluster int, doc_id int")


def test_repeated_lines(spark):
    data, df = line_table(spark)
    paths, held, occ = collections.defaultdict(set), collections.defaultdict(set), []
    for i, s, p, b, *_ in data:
        for no, x in enumerate(repeatedlines.body_lines(b) or []):
            paths[s].add(p)
            if letters(x):
                held[s, letters(x)].add(p)
                occ.append((i, no, s, letters(x)))
    exp = [(i, no) for i, no, s, k in occ if len(held[s, k]) >= 5 and 10 * len(held[s, k]) >= len(paths[s])]
    got = repeatedlines.repeated_line_cases(df, "page_id", "source_id", F.xxhash64("path"), "body")
    assert rows(got) == sorted(exp, key=repr) and exp
    clean = repeatedlines.without_repeated_lines(df, "page_id", "source_id", F.xxhash64("path"), "body")
    assert sum(r.n_removed for r in clean.collect()) == len(exp) and clean.count() == 81
    assert repeatedlines.repeated_line_cases(df.limit(0), "page_id", "source_id", F.xxhash64("path"), "body").collect() == []


def test_copies_of_one_document_are_one_cluster(spark):
    df = spark.createDataFrame([(i, "s", "same", body("boiler plate")) for i in range(50)], "page_id long, source_id string, path string, body string")
    assert repeatedlines.repeated_line_cases(df, "page_id", "source_id", F.xxhash64("path"), "body").collect() == []


def test_copies_in_other_encodings_are_one_cluster(spark, tmp_path):
    pages = [[f"own line {chr(97 + i)}", "boiler plate"] for i in range(6)]
    first, second = body(*pages[0]), body(*pages[1])
    data = [(i, "s", f"p{i}", body(*x)) for i, x in enumerate(pages)]
    data += [(10, "s", "twice", json.dumps(first)), (11, "s", "pretty", json.dumps(json.loads(first), indent=2)), (12, "s", "both", json.dumps(json.dumps(json.loads(second), indent=1)))]
    data += [(13, "s", "p0", first), (14, "s", "cut off", first[:-1]), (15, "s", "moved", body(*pages[0][::-1]))]
    spark.createDataFrame(data, "page_id long, source_id string, path string, body string").write.parquet(f"{tmp_path}/stored_pages.parquet")
    dates = [(("/" if i % 2 else "") + x[2], f"2025-01-0{1 + i // 4} 10:00:00") for i, x in enumerate(data)]
    spark.createDataFrame([("s", *x) for x in dates], "source_id string, path string, at string").selectExpr("source_id", "path", "cast(at as timestamp) as fetched_at").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r)[2:] for r in QUERIES["p1_line_counts"](spark, str(tmp_path)).collect()}
    assert got == {(7, 3, 7)}  # the boiler plate: seven clusters, first fetched on three days, of seven


def test_republished_articles_and_single_days(spark):
    article = ["long read", "by nobody", "all rights kept"]
    data = [(i, "s", f"a{i}", body(*article)) for i in range(8)] + [(20 + i, "s", f"b{i}", body(f"own {chr(97 + i)}", "share this", "sale today" if i < 6 else "later")) for i in range(12)]
    df = spark.createDataFrame(data, "page_id long, source_id string, path string, body string")
    lines = repeatedlines.keyed_lines(df, "page_id", "source_id", None, "body")
    dated = lines.withColumn("date", F.expr("date '2025-01-01' + if(doc_id >= 26, cast(doc_id as int), 0)"))
    named = {repeatedlines.line_key(x): x for x in ("long read", "by nobody", "all rights kept", "share this", "sale today", "later")}
    got = {(named[r.line_key], r.n_clusters, r.n_total) for r in repeatedlines.excessive(repeatedlines.line_counts(dated, dates=True)).collect()}
    assert got == {("share this", 12, 13), ("later", 6, 13)}  # the article is one cluster, the sale one day
    by_path = repeatedlines.repeated_line_cases(df, "page_id", "source_id", F.xxhash64("path"), "body")
    assert by_path.where("doc_id < 20").count() == 24  # eight paths, where the path is the document


def test_copies_collapse_before_their_paths_count(spark):
    """One article at many paths is counted once, with its paths; a path delivered with several contents is one."""
    r, data = random.Random(7), []
    texts = [[f"own {chr(97 + i)}", *r.sample(["menu", "footer", "share this", "long read", "by nobody"], r.randrange(4))] for i in range(12)] + [["12", ""]]
    for i in range(160):
        text = body(*r.choice(texts[i % 3 :: 3]))
        path = None if i % 31 == 0 else f"p{r.randrange(50)}"
        data.append((i, [None, "s", "t"][i % 3], path, r.choice([text, text, json.dumps(text), json.dumps(json.loads(text), indent=1)])))
    df = spark.createDataFrame(data, "page_id long, source_id string, path string, body string")
    lines = repeatedlines.keyed_lines(df, "page_id", "source_id", F.xxhash64("path"), "body").cache()
    contents, places, held, occ = set(), collections.defaultdict(set), collections.defaultdict(set), []
    for i, s, p, b in data:
        keys = [repeatedlines.line_key(x) for x in repeatedlines.body_lines(b)]
        content = tuple(k for k in keys if k is not None)
        contents.add(content)
        for no, k in [(None, None), *enumerate(keys)]:
            if no is None or k is not None:
                places[s, k].add(p)
                held[s, k].add(content)
                occ.append((i, no, s, k))
    assert lines.select("cluster").distinct().count() == len(contents) <= 13
    assert rows(repeatedlines.place_counts(lines)) == sorted(((*x, len(v)) for x, v in places.items()), key=repr)
    for place, n, least in ((F.xxhash64("path"), places, 20), (None, held, 2)):
        exp = [(i, no) for i, no, s, k in occ if k is not None and len(n[s, k]) >= least and 2 * len(n[s, k]) >= len(n[s, None])]
        got = repeatedlines.repeated_line_cases(df, "page_id", "source_id", place, "body", least, 0.5)
        assert rows(got) == sorted(exp, key=repr) and 0 < len(exp) < len(occ) - len(data)


# Near duplicates


def similar_table(seed=2):
    r, texts = random.Random(seed), []
    vocab = [f"w{i}" for i in range(300)]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 30, 80]))]
        texts.append(base)
        for _ in range(r.randrange(4)):
            t = list(base)
            for _ in range(r.randrange(max(1, len(t) // 12))):
                t[r.randrange(len(t))] = r.choice(vocab)
            texts.append(t)
    data = [(i, body(" ".join(t))) for i, t in enumerate(texts)]
    return data + [(900, None), (901, ""), (902, body("one two")), (903, body("one two")), (904, data[0][1]), (905, body("very " * 50_000))]


def test_similar_pairs_and_groups(spark):
    data = similar_table()
    df = spark.createDataFrame([(i, b, "x", 0) for i, b in data], "page_id long, body string, id string, n int")
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, b in data for w in [body_words(b) or []]}
    exp = {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if x | y and 5 * len(x & y) >= 3 * len(x | y)}
    got = [tuple(r) for r in nearduplicates.similar_pairs(df, "page_id", "body", body_words, 3, 0.6).collect()]
    assert set(got) == exp and len(got) == len(exp) and len(exp) > 15
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in exp:
        up[max(root(a), root(b))] = min(root(a), root(b))
    groups = nearduplicates.similar_groups(df, "page_id", "body", body_words, 3, 0.6).collect()
    assert {r.id: r.group_id for r in groups} == {i: root(i) for i in sets} and len(groups) == len(data)
    assert nearduplicates.similar_pairs(df.limit(0), "page_id", "body", body_words, 3, 0.6).collect() == []
    assert nearduplicates.similar_groups(df.limit(0), "page_id", "body", body_words, 3, 0.6).collect() == []


def test_many_copies_give_links_not_all_pairs(spark):
    n = nearduplicates.COPY_PAIRS + 50
    df = spark.createDataFrame([(i, body("a b c d e f")) for i in range(n)], "page_id long, body string")
    got = rows(nearduplicates.similar_pairs(df, "page_id", "body", body_words, 3, 0.6))
    assert got == [(0, i) for i in sorted(range(1, n), key=lambda i: repr((0, i)))]


def test_pairs_of_differing_texts_are_whole_however_many(spark):
    n, text = nearduplicates.COPY_PAIRS + 2, "a b c d e f g h i j"
    data = [(i, body(text)) for i in range(n)] + [(1000, body(text.upper())), (1001, body(text + ".")), (1002, body(text + ".")), (2000, body(text + " k"))]
    got = rows(nearduplicates.similar_pairs(spark.createDataFrame(data, "page_id long, body string"), "page_id", "body", body_words, 3, 0.6))
    exp = [(0, i) for i in range(1, n)] + [(i, j) for i in range(n) for j in (1000, 1001, 1002, 2000)] + list(itertools.combinations((1000, 1001, 1002, 2000), 2))
    assert got == sorted(exp, key=repr)


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(40):
            common, rest = r.integers(0, 2**63, int(200 * share), dtype=np.uint64), r.integers(0, 2**63, 200, dtype=np.uint64)
            k = 200 - len(common)
            a, b = np.concatenate([common, rest[: k // 2]]), np.concatenate([common, rest[k // 2 : k]])
            s = nearduplicates.superminhash(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
            errors.append((s[0] == s[1]).mean() - len(common) / (len(a) + len(b) - len(common)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_each_element_visits_every_slot():
    s = nearduplicates.superminhash(np.zeros(1, np.int64), np.array([7], np.uint64), 1)
    assert sorted((s[0] >> np.uint64(32)).tolist()) == list(range(nearduplicates.SLOTS))


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(500 + i, 501 + i) for i in range(200)] + [(None, 1), (3, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert rows(components.components(df)) == sorted(((x, root(x)) for x in up), key=repr)
    assert components.components(df.limit(0)).collect() == []


# Frequencies


def test_term_frequencies(spark):
    r, data = random.Random(6), []
    for i in range(300):
        data.append((r.choice(["a", "b", None]), str(r.randrange(60)), " ".join(r.choice(["tic", "tac", "toe", f"x{r.randrange(200)}"]) for _ in range(r.randrange(9)))))
    data += [("a", "n", None), ("a", "e", ""), ("hot", "k", "tic")] + [("hot", "k", "tic tac")] * 100 + [("a", "l", "long " * 100_000)]
    df = spark.createDataFrame([(*x, "c", 1) for x in data], "s string, p string, t string, term string, record int").repartition(6)
    held, occ, records = collections.defaultdict(set), collections.Counter(), set()
    for s, p, t in data:
        records.add((s, p))
        occ.update(words(t))
        for w in words(t):
            held[w].add((s, p))
    exp = {(w, occ[w], len(x)) for w, x in held.items()}
    got = vocabulary.term_frequencies(df, ["s", "p"], "t", words)
    seen = {tuple(x) for x in got.collect()}
    assert {x for x in seen if x[0]} == exp and {x[2] for x in seen if not x[0]} == {len(records)}
    marks = {x.term: x.mark for x in vocabulary.marked(got).collect()}
    assert marks == {w: "rare" if len(x) == 1 else "common" if 4 * len(x) > len(records) else None for w, x in held.items()}
    assert vocabulary.marked(vocabulary.term_frequencies(df.limit(0), ["s", "p"], "t", words)).collect() == []


def test_containers_switch_to_bitmaps():
    import pyarrow as pa

    record = np.concatenate([np.arange(5000), np.arange(5000), [9, 70_000, 70_001]])
    term = np.concatenate([np.zeros(10_000), [1, 1, 1]]).astype(np.int64)
    b = vocabulary._containers(term, record, np.ones(len(term), np.int64), pa.array(["all", "few"]))
    assert b.column("card").to_pylist() == [5000, 1, 2] and b.column("occ").to_pylist() == [10_000, 1, 2]
    assert [len(vocabulary._members(i, x)) for i, x in zip(b.column("ids").to_pylist(), b.column("bits").to_pylist())] == [5000, 1, 2]
    assert len(b.column("bits")[0].as_py()) == 625


# Page bodies


def lines_of(html, classes=()):
    _, blocks, outers, texts, _ = sitetemplates.segments(html, frozenset(classes))
    return sitetemplates.kept_lines(blocks, outers, texts)


def test_lines_of_a_page():
    html = """<body><h1>A &amp; b<span class="TOP x">[source]</span></h1><p>one<p>two<br>three&nbsp;four<table><tr><th>a</th><td>b<tr><td><em>c</em></table>
<ul><li>x<ul><li>y</ul></ul><p>t <span hidden>no</span>u<button>Copy</button><!-- <p>c</p> --><script>'<p>'</script><template><p>z</p></template><p style="display: none">q"""
    assert lines_of(html, ["top"]) == ["A & b", "one", "two three four", "a", "b", "c", "y", "t u"]
    assert lines_of(None) == lines_of("") == lines_of("just text") == []


def test_site_templates(spark):
    r, data = random.Random(7), []
    say = lambda: " ".join(r.choice("alpha beta gamma delta epsilon".split()) + str(r.randrange(999)) for _ in range(6))
    want = {}
    for i in range(40):
        title, text = say(), say()
        want[i] = {title, text, "same cell", f"cell {i}"}
        data.append((i, "h" if i < 30 else None, f"/{i}", f"<body><h2>Site</h2><div class=qx><p>Read this too</p><a href=/a>{say()}</a></div><div class=doc><h1>{title}</h1><p>{text}<table><td>same cell<td>cell {i}</table></div><div class='f z'><p>© {i}</p></div>", "x"))
    data += [(50, "h", "/0", None, "x"), (51, "lone", "/1", "<h1>T</h1><div class=qx><p>kept</p></div>", "x"), (None, None, None, None, None)]
    df = spark.createDataFrame(data, "raw_id long, host string, address string, html string, segments string")
    got = collections.defaultdict(set)
    for x in sitetemplates.main_lines(df, "raw_id", "host", "address", "html").collect():
        got[x.id].add(x.main_line)
    assert got == {**want, 51: {"T", "kept"}}
    assert sitetemplates.main_lines(df.limit(0), "raw_id", "host", "address", "html").collect() == []


def test_classed_blocks_of_an_author_stay(spark):
    r, data, want = random.Random(12), [], {}
    say = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    for i in range(40):
        lead, note, code = say(12), say(20), say(9)
        want[i] = {f"T {i}", lead, note, code}
        stamp = f"This page was changed {i} days ago and has been seen {i * 7} times"
        more = f"<div class=more><p>See also</p>{''.join(f'<p><a href=/{say(1)}>{say(12)}</a></p>' for _ in range(i % 4 + 1))}</div>"
        data.append((i, "h", f"/{i}", f"<body><div class=doc><h1>T {i}</h1></div><p class=lead>{lead}</p><div class=admonition><p>{note}</p></div><div class=highlight><pre>{code}</pre></div><div class=stamp><p>{stamp}</p></div>{more}"))
    df = spark.createDataFrame(data, "raw_id long, host string, address string, html string")
    got = collections.defaultdict(set)
    for x in sitetemplates.main_lines(df, "raw_id", "host", "address", "html").collect():
        got[x.id].add(x.main_line)
    assert got == want


def test_short_blocks_of_generator_classes_stay(spark):
    """Unique texts under the classes of generators stay, however short; fixed wording under the same markup goes."""
    data, want = [], {}
    for i in range(40):
        n = f"{chr(97 + i % 26)}{chr(97 + i // 26)}"
        own = {f"T {n}", f"lead {n}", f"head {n}", f"said {n}", f"run {n}", f"cell {n}", f"link {n}"}
        fixed = "<p class=lead>Draft</p><div class=section><h3>Build</h3><p>Build 1.{n}</p></div>".replace("{n}", str(i))
        page = f"<div class=doc><h1>T {n}</h1></div><p class=lead>lead {n}</p><div class=section><h2>head {n}</h2><p>said {n}</p></div><pre class=highlight>run {n}</pre><table class=docutils><tr><td>cell {n}</table><ul class=simple><li><a href=/{n}>link {n}</a></ul>"
        data.append((i, "h", f"/{i}", page + fixed))
        want[i] = own
    df = spark.createDataFrame(data, "raw_id long, host string, address string, html string")
    got = collections.defaultdict(set)
    for x in sitetemplates.main_lines(df, "raw_id", "host", "address", "html").collect():
        got[x.id].add(x.main_line)
    assert got == want


def test_templates_against_plain_counting(spark, data):
    """Recurring subtrees of the given pages, counted page by page without Spark."""
    given = spark.read.parquet(f"{data}/raw_pages.parquet").selectExpr("raw_id", "source_id as host", "url as address", "html").collect()
    pages, seen = collections.defaultdict(set), collections.defaultdict(set)
    for r in given:
        pages[r.host].add(r.address)
        for h in sitetemplates.segments(r.html, frozenset())[0]:
            seen[r.host, h].add(r.address)
    bad = {k for k, at in seen.items() if len(at) >= (3 if k[1] % 2 else 2) and 20 * len(at) >= len(pages[k[0]])}
    exp = set()
    for r in given:
        hashes, blocks, outers, texts, arounds = sitetemplates.segments(r.html, frozenset())
        kept = [not any((r.host, hashes[i]) in bad for i in a) for a in arounds]
        exp |= {(r.raw_id, x) for x in sitetemplates.kept_lines(*([x for x, k in zip(c, kept) if k] for c in (blocks, outers, texts)))}
    df = spark.createDataFrame([tuple(r) for r in given], "raw_id long, host string, address string, html string")
    assert {tuple(x) for x in sitetemplates.main_lines(df, "raw_id", "host", "address", "html").collect()} == exp and len(exp) > 100


def test_a_page_fetched_often_is_no_template(spark):
    page = "<h1>T</h1><div class=a><p>x</p></div>"
    df = spark.createDataFrame([(i, "h", "/same", page) for i in range(20)], "raw_id long, host string, address string, html string")
    assert {x.main_line for x in sitetemplates.main_lines(df, "raw_id", "host", "address", "html").collect()} == {"T", "x"}


# Packing

VOCABULARY = packing.read_vocabulary(P8_TOKENIZER)


@pytest.mark.parametrize("capacity", [10, 64])
def test_best_fit_is_valid(capacity):
    r = np.random.default_rng(3)
    sizes = r.integers(0, capacity + 1, 500)
    bins, fill = packing.best_fit(sizes, capacity)
    assert (np.bincount(bins, sizes, len(fill)) == fill).all() and fill.max() <= capacity
    open_ = np.sort(fill)
    assert open_[0] + open_[1] > capacity  # no two bins fit into one
    assert len(fill) <= 1.25 * sizes.sum() / capacity + 1


def test_pack(spark):
    r = random.Random(8)
    data = [(i, " ".join("word" for _ in range(r.choice([1, 5, 20, 200])))) for i in range(400)] + [(900, None), (901, ""), (902, "x " * 3000), (902, "y"), (None, "z")]
    df = spark.createDataFrame([(*x, "c", 1) for x in data], "doc_id long, text string, bin_id string, size int").repartition(20)
    cap = 128
    got = packing.pack(df, "doc_id", "text", P8_TOKENIZER, cap).collect()
    fill = collections.Counter()
    for x in got:
        fill[x.bin_id] += x.size
    assert max(fill.values()) <= cap and sum(fill.values()) == sum(packing.count_tokens(t, VOCABULARY) for _, t in data)
    pieces = collections.Counter(x.id for x in got)
    need = collections.Counter()
    for i, t in data:
        need[i] += max(1, -(-packing.count_tokens(t, VOCABULARY) // cap))
    assert pieces == need
    alone = packing.best_fit(np.array([x.size for x in got]), cap)[1]
    assert len(fill) <= 1.03 * len(alone) + 2  # nearly as few as one task would need
    assert packing.pack(df.limit(0), "doc_id", "text", P8_TOKENIZER, cap).collect() == []


@pytest.mark.parametrize("capacity", [10, 64, 4096])
def test_runs_are_best_fit(capacity):
    """Best fit over counts, against best fit item by item."""
    r = np.random.default_rng(capacity)
    for n in (0, 1, 50, 2000):
        sizes = r.integers(0, capacity + 1, n)
        counts = dict(zip(*np.unique(sizes, return_counts=True)))
        runs = packing.Runs({int(k): int(v) for k, v in counts.items()}, capacity)
        order = np.argsort(sizes, kind="stable")
        place = np.zeros(n, np.int64)
        place[order] = np.arange(n) - np.searchsorted(sizes[order], sizes[order])
        bins = runs.bin_of(sizes, place)
        fill = np.bincount(bins, sizes, runs.bins)
        assert (np.bincount(bins, minlength=runs.bins) > 0).all() and (fill <= capacity).all()
        assert sorted(fill.tolist()) == sorted(packing.best_fit(sizes, capacity)[1].tolist())


def test_sizes_that_cluster_by_partition(spark):
    """Partitions of large items only and of small ones only: their bins must be opened."""
    cap = 128
    data = [(i, " ".join(["word"] * (82 if i // 50 % 2 else 46))) for i in range(1000)]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, text string").repartitionByRange(20, "doc_id"), "doc_id", "text", P8_TOKENIZER, cap).collect()
    sizes = np.array([x.size for x in got])
    alone = len(packing.best_fit(sizes, cap)[1])
    assert len({x.bin_id for x in got}) <= 1.02 * alone and len(got) == 1000


def test_tokens_of_long_blanks():
    for text in ("a" + " " * 5000 + "b c", " " * 4097, "x" + "\n" * 6000, "a" * 300_000):
        exact = len(packing.encoding(VOCABULARY).encode_ordinary(text))
        assert packing.count_tokens(text, VOCABULARY) == exact
    assert packing.count_tokens("a" + " " * 1_000_000 + "b", VOCABULARY) > 1000


# Leakage


def leak_tables(spark):
    r = random.Random(9)
    w = lambda n: [f"v{r.randrange(50)}" for _ in range(n)]
    items = [(i, w(r.choice([5, 12, 30]))) for i in range(20)] + [(20, ["a"] * 40)]
    docs = []
    for i in range(240):
        d = w(60)
        if i % 3 == 0:
            _, t = r.choice(items)
            a = r.randrange(max(1, len(t) - 8))
            d[20:20] = t[a : a + r.choice([8, 11, 12, 13, 30])]
        docs.append((i, d))
    docs += [(998, items[2][1][::-1]), (999, ["a"] * 30)]
    it = [(i, " ".join(t)) for i, t in items] + [(21, None), (22, "")]
    do = [(i, ", ".join(t).upper()) for i, t in docs] + [(1000, None), (1001, ""), (1002, it[1][1]), (1002, it[1][1]), (None, it[2][1])]
    return it, do, spark.createDataFrame([(*x, 0) for x in it], "item_id long, text string, id int"), spark.createDataFrame([(*x, 0) for x in do], "doc_id long, text string, seed int")


def test_overlaps_both_ways(spark):
    it, do, items, docs = leak_tables(spark)

    def grams(text):
        w = words(text)
        return {tuple(w[j : j + 12]) for j in range(len(w) - 11)}

    exp = {(d, i) for d, x in do for i, y in it if grams(x) & grams(y)}
    for seed_rows in (leakage.SEED_ROWS, 0):
        got = leakage.overlaps(docs, items, seed=12, seed_rows=seed_rows).collect()
        assert {(r.doc_id, r.item_id) for r in got} == exp and len(got) == len(exp) and len(exp) > 8
        assert all(r.longest >= 12 and 0 < r.coverage <= 1 for r in got)
    assert leakage.overlaps(docs.limit(0), items).collect() == [] and leakage.overlaps(docs, items.limit(0)).collect() == []


def test_tiling_finds_moved_parts():
    own = [f"w{i}" for i in range(60)]
    ready = leakage.Items([(1, " ".join(own))], 6)
    assert ready.compare(" ".join(own[30:] + ["x"] + own[:30])) == [(1, 2, 60, 1.0, 30)]
    assert ready.compare(" ".join(own[:20] * 3))[0][:4] == (1, 1, 20, 20 / 60)
    assert ready.compare(" ".join(own[:5])) == []


def test_rolling_hashes_are_position_free():
    h = nearduplicates.word_hashes("a b c x a b c".split())
    w = leakage.Rolling(h).windows(3)
    assert w[0] == w[4] and len(set(w.tolist())) == 4


# Subjects


def test_subjects(spark):
    r = random.Random(10)
    lexicon = {s: [f"{s}{i}" for i in range(12)] for s in ("law", "sport", "music")}
    lexicon = {s: [f"{s}{chr(97 + i)}word" for i in range(12)] for s in lexicon}
    common = [f"gen{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    docs, truth = [], {}
    for i in range(400):
        about = r.choice([["law"], ["sport"], ["music"], ["law", "sport"], []])
        w = [r.choice(common) for _ in range(80)] + [r.choice(lexicon[s]) for s in about for _ in range(8)]
        if r.random() < 0.3:
            w.append(r.choice(lexicon["music"]))  # a passing mention
        r.shuffle(w)
        docs.append((i, " ".join(w)))
        truth[i] = set(about)
    labels = [(i, s, "a") for i in range(0, 400, 3) for s in truth[i]]
    labels += [(1, "law", "b")] * 2 + [(3, "nope", "b"), (None, "law", "b"), (6, None, "b"), (0, "music", "b")]
    docs += [(900, None), (901, ""), (None, "x")]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, text string")
    names = spark.createDataFrame([(s,) for s in lexicon] + [(None,)], "subject string")
    got = collections.defaultdict(set)
    for x in subjects.subjects(d, lab, names).collect():
        got[x.doc].add(x.subject)
    right = sum(got[i] == truth[i] for i in truth)
    assert right >= 0.97 * len(truth) and not got[900] and not got[901]
    assert subjects.subjects(d.limit(0), lab, names).collect() == [] and subjects.subjects(d, lab.limit(0), names).collect() == []


def test_labels_travel_over_unlabelled_documents(spark):
    r = random.Random(11)
    common, law, sport, far = ([f"{k}{chr(97 + i)}{chr(97 + j)}word" for i in range(n) for j in range(12)] for k, n in (("gen", 40), ("law", 1), ("sport", 1), ("bail", 1)))
    docs = [[*r.choices(common, k=40), *r.choices(own, k=8)] for own in (law, sport) for _ in range(60)]
    docs += [[*r.choices(common, k=40), *r.choices(law, k=8), *far] for _ in range(60)]
    docs += [[*r.choices(common, k=40), *far[:8]] for _ in range(6)]  # of law only over the documents before
    docs += [r.choices(common, k=40) for _ in range(1000)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, "law" if i < 60 else "sport") for i in range(120)], "doc_id long, subject string")
    names = spark.createDataFrame([("law",), ("sport",)], "subject string")
    got = {x.doc for x in subjects.subjects(d, lab, names).where("subject = 'law'").collect()}
    assert got == {*range(60), *range(120, 186)}


def test_hubs_carry_what_the_links_do():
    """What a document receives over hubs, against the sum over every single link."""
    r = random.Random(14)
    n_terms, n_docs, n_subjects = 9, 40, 3
    held = [sorted(r.sample(range(n_terms), r.randrange(2, 6))) for _ in range(n_docs)]
    band = subjects.Band(np.arange(n_terms, dtype=np.int32), np.ones(n_terms, np.int64), n_docs)
    linked = sorted(r.sample([a * n_terms + b for a in range(n_terms) for b in range(a + 1, n_terms)], 20))
    hubs = subjects.Hubs(band, np.array(linked), np.zeros(20, np.int64))
    labels = [set(r.sample(range(n_subjects), r.randrange(3))) for _ in range(n_docs)]
    heard = np.array([bool(x) or r.random() < 0.5 for x in labels])
    of = [{i for i, k in enumerate(linked) if k // n_terms in h and k % n_terms in h} for h in held]
    entries = collections.Counter((h, s) for d in range(n_docs) for h in of[d] for s in labels[d])
    count = np.array([sum(h in of[d] and heard[d] for d in range(n_docs)) for h in range(20)])
    sums = subjects.Sums(count, *(np.array([f(e) for e in entries]) for f in (lambda e: e[0], lambda e: e[1], lambda e: entries[e])))
    own, sizes = hubs.of(np.concatenate([np.array(h) for h in held]), np.array([len(h) for h in held]))
    assert [set(x) for x in np.split(own, np.cumsum(sizes)[:-1])] == of
    known = np.array(sorted(d * n_subjects + s for d in range(n_docs) for s in labels[d]))
    got = {(int(a), int(t), int(s)): w for a, t, s, w in zip(*subjects.received(hubs, sums, np.repeat(np.arange(n_docs), sizes), own, known, heard.astype(np.int64), n_subjects)) if w > 0}
    total, share = collections.Counter(), collections.Counter()
    for a, b in itertools.permutations(range(n_docs), 2):
        for h in of[a] & of[b] if heard[b] else ():  # the link from b to a
            for t in (linked[h] // n_terms, linked[h] % n_terms):
                total[a, t] += 1
                share.update((a, t, s) for s in labels[b])
    assert got.keys() == share.keys() and len(got) > 100
    assert all(abs(got[k] - share[k] / (total[k[:2]] + subjects.SHRINK)) < 1e-12 for k in got)


def test_pairs_of_long_texts_come_in_blocks():
    i, j = (np.concatenate(x) for x in zip(*subjects._pairs(3000)))
    assert len(i) == 3000 * 2999 // 2 and (i < j).all() and len(np.unique(i * 3000 + j)) == len(i)


def test_queries_on_small_tables(spark, data):
    for name, f in QUERIES.items():
        f(spark, data).collect()
    assert "p10_found" in QUERIES
