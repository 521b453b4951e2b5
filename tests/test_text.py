import pytest
from pyspark.sql import functions as F

from docquarry.functions import ids, text, urls
from docquarry.functions.words import letters, words


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr("c").alias("x")).first()[0]


@pytest.mark.parametrize("s, out", [("Größe, ﬁne-tuned", ["größe", "fine", "tuned"]), ("kae­nhex​bra x1_y", ["kaenhexbra", "x1", "y"]), (None, []), ("", []), ("été", ["été"]), ("A" * 100_000, ["a" * 100_000])])
def test_words(s, out):
    assert words(s) == out


def test_letters():
    assert letters("© 2013–2021 LINDAFI — project.") == letters("Lindafi  Project!") == "lindafiproject"


@pytest.mark.parametrize(
    "s, out",
    [
        ("read_to_string", [("read_to_string", 0, 3), ("read", 0, 1), ("to", 1, 1), ("string", 2, 1)]),
        ("HTTPServer v2", [("httpserver", 0, 2), ("http", 0, 1), ("server", 1, 1), ("v2", 2, 1)]),
        ("plain", [("plain", 0, 1)]),
        ("__", []),
        ("", []),
        ("a" * 121, []),
    ],
)
def test_code_tokens(spark, s, out):
    assert [tuple(t) for t in one(spark, s, text.code_tokens)] == out


def test_code_tokens_of_null(spark):
    assert one(spark, None, text.code_tokens) is None


@pytest.mark.parametrize("s, out", [("how do I (use) C++", "how do I use C"), ('a "b c" AND d', 'a "b c" and d'), ('odd " quote', "odd quote"), ("NOTE IN ORDER", "NOTE in ORDER")])
def test_plain_text_query(spark, s, out):
    assert one(spark, s, text.plain_text_query) == out


@pytest.mark.parametrize("s, out", [("how do I read a file", "read file"), ("how to do", "how to do"), ('how "to do"', 'how "to do"'), ("return type if in", "return type if in")])
def test_stopwords(spark, s, out):
    assert one(spark, s, text.drop_stopwords) == out


def test_forced_symbols(spark):
    assert one(spark, "@Vec foo @ @push x@y", text.forced_symbols) == ["Vec", "push"]


@pytest.mark.parametrize("a, b, limit, out", [("manifset", "manifest", 2, 1), ("ca", "abc", 3, 3), ("kitten", "sitting", 2, None), ("", "", 0, 0), ("abc", "abcd", 0, None)])
def test_osa(a, b, limit, out):
    assert text.osa_distance(a, b, limit) == out


def test_osa_in_frame_and_allowed_distance(spark):
    df = spark.createDataFrame([("manifset", "manifest"), (None, "x"), ("cat", "cut")], "a string, b string")
    got = df.select(text.osa_distance_udf("a", "b", text.allowed_distance("b")).alias("d"), text.allowed_distance("b").alias("n")).collect()
    assert [tuple(r) for r in got] == [(1, 2), (None, 0), (None, 0)]


def test_byte_truncate():
    assert text.byte_truncate("aé", 2) == "a" and text.byte_truncate("aé", 3) == "aé"


@pytest.mark.parametrize("s, ok", [("std", True), ("a.b-c_d+e", True), (".x", False), ("", False), ("a" * 64, True), ("a" * 65, False), ("a b", False), ("a\n", False)])
def test_source_ids(spark, s, ok):
    assert one(spark, s, ids.source_id_valid) is ok


@pytest.mark.parametrize("s, ok", [("a/b.html", True), ("/a", False), ("a//b", False), ("a/../b", False), ("./a", False), ("a\\b", False), ("", False), ("é" * 1025, False), ("a..b", True)])
def test_page_paths(spark, s, ok):
    assert one(spark, s, ids.page_path_valid) is ok


@pytest.mark.parametrize("s, out", [("https://x.y/a/b.html?q#f", "a/b.html"), ("https://x.y", "index.html"), ("https://x.y/a/", "a/index.html"), ("https://x.y/a//b", None)])
def test_page_path_of_url(spark, s, out):
    got = one(spark, s, urls.page_path)
    assert got == urls.page_path_of(s) and (got == out if out else got.startswith("pages/") and len(got) == 27)


@pytest.mark.parametrize("s, out", [("https://docs.x.org/a", "in_scope"), ("ftp://x.org/", "wrong_scheme"), ("https://y.org/", "off_host"), ("https://x.org/old/1", "excluded"), ("https://x.org/z", "not_included")])
def test_scope(spark, s, out):
    assert one(spark, s, lambda c: urls.scope(c, F.lit("https://www.x.org/"), ["^/a", "^/old"], ["^/old"])) == out


def test_links(spark):
    got = {s: (one(spark, s, urls.link_scheme), one(spark, s, urls.link_class)) for s in ("java\tscript:x", "#a", "//h/x", "a/b:c", "MAILTO:x")}
    assert got == {"java\tscript:x": ("javascript", "external"), "#a": ("", "fragment"), "//h/x": ("", "external"), "a/b:c": ("", "page"), "MAILTO:x": ("mailto", "external")}
