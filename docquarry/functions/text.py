"""Text analysis as column expressions: tokens, query words, slugs, escapes.

Nearly all of it stays inside the JVM; code tokens with positions and the edit distance
with transpositions are Arrow functions, for no built-in ones do. Null in, null out.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
QUESTION_WORDS = "how what when where which who whom why do does did doing can could should would shall will may might must".split()
FUNCTION_WORDS = "a an the of to from at by on into onto about i me my we us our you your it its this that these those am are was were be been being there here then than some any".split()
STRUCTURAL = "+-!():^[]{}~*?\\/&|<>="
MAX_TOKEN_BYTES, MAX_CODE_BYTES, MAX_TERM_CHARS = 40, 120, 40


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def default_tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and numbers of at most 40 bytes, in order."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= MAX_TOKEN_BYTES))


def code_words(c: Column | str) -> Column:
    """Runs of letters, numbers, ``_`` and ``-``."""
    return F.filter(F.split(_col(c), r"[^\p{L}\p{N}_-]+"), lambda t: t != "")


def code_parts(word: Column) -> Column:
    """An identifier's parts: split at ``_`` and ``-``, before a capital after a small
    letter or digit, and before the last capital of an acronym."""
    marked = F.regexp_replace(word, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    return F.filter(F.split(marked, "[_-]+"), lambda t: t != "")


_CODE_WORD = re.compile(r"[\w-]+")
_PART = regex.compile(r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|[_-]+")


def code_token_list(text: str) -> list[tuple[str, int, int]]:
    """(token, pos, len) of code, see :func:`code_tokens`."""
    out, at = [], 0
    for word in _CODE_WORD.findall(text):
        if word.islower() and "_" not in word and "-" not in word:
            parts = [word]
        else:
            parts = [p for p in _PART.split(word) if p]
            if len(parts) > 1:
                out.append((word.lower(), at, len(parts)))
        out += [(p.lower(), at + i, 1) for i, p in enumerate(parts)]
        at += len(parts)
    return [t for t in out if len(t[0].encode()) <= MAX_CODE_BYTES]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("len", T.IntegerType())])))
def _code_tokens(c: pa.Array) -> pa.Array:
    lists = [None if s is None else code_token_list(s) for s in c.to_pylist()]
    flat = [t for x in lists if x for t in x]
    kinds = (pa.string(), pa.int32(), pa.int32())
    items = pa.StructArray.from_arrays([pa.array([t[i] for t in flat], k) for i, k in enumerate(kinds)], ["token", "pos", "len"])
    off, n = [], 0
    for x in lists:
        off.append(None if x is None else n)
        n += len(x or ())
    return pa.ListArray.from_arrays(pa.array([*off, n], pa.int32()), items)


def code_tokens(c: Column | str) -> Column:
    """(token, pos, len) of code: each word whole, if it has parts, and then its parts.
    The whole stands at its first part's position and spans all of them. Tokens over
    120 bytes are dropped, never cut. An Arrow function: built-in ones can only carry
    the running position through an aggregate that copies its result at every word."""
    return _code_tokens(_col(c))


def plain_text_query(c: Column | str) -> Column:
    """A query with nothing left for a query parser: structural characters become
    spaces, quotes stay only if balanced, the words AND OR NOT IN are lower-cased."""
    c = _col(c)
    bare = F.translate(c, STRUCTURAL, " " * len(STRUCTURAL))
    even = F.length(c) - F.length(F.replace(c, F.lit('"'))) 
    quoted = F.when(even % 2 == 0, bare).otherwise(F.translate(bare, '"', " "))
    out = F.array_join(F.filter(F.split(quoted, r"\s+"), lambda w: w != ""), " ")
    for word in ("AND", "OR", "NOT", "IN"):
        out = F.regexp_replace(out, rf"(?<![^ ]){word}(?![^ ])", word.lower())
    return out


def forced_symbols(c: Column | str) -> Column:
    """The names after ``@`` in a query; other words are dropped."""
    marked = F.filter(F.split(_col(c), r"\s+"), lambda w: w.rlike("^@."))
    return F.transform(marked, lambda w: w.substr(F.lit(2), F.length(w)))


def drop_stopwords(c: Column | str, words: list[str] | None = None) -> Column:
    """A query without question and function words; unchanged if it is quoted or nothing would be left."""
    stop = F.array(*[F.lit(w) for w in (words or QUESTION_WORDS + FUNCTION_WORDS)])
    all_words = F.filter(F.split(_col(c), r"\s+"), lambda w: w != "")
    kept = F.filter(all_words, lambda w: ~F.array_contains(stop, F.lower(w)))
    return F.when(_col(c).contains('"') | (F.size(kept) == 0), _col(c)).otherwise(F.array_join(kept, " "))


def facet_path(c: Column | str) -> Column:
    """``a / b`` as ``/a/b``; ``/`` for nothing."""
    parts = F.filter(F.transform(F.split(_col(c), "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def slug(c: Column | str) -> Column:
    """Lower case, with white space, quotes and controls as single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[\s\x00-\x1f\x7f\"'`]+", "-"), "^-+|-+$", "")


def clean_id(c: Column | str) -> Column:
    """An element id without white space, controls and quotes."""
    return F.regexp_replace(_col(c), r"[\s\x00-\x1f\x7f\"'`]", "")


def clean_token(c: Column | str) -> Column:
    """A class token of ``a-z0-9-``; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9-]", ""), F.lit(""))


def html_escape(c: Column | str) -> Column:
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def redact(c: Column | str, home: str) -> Column:
    """A text with a home folder shown as ``~``."""
    return F.replace(_col(c), F.lit(home.rstrip("/")), F.lit("~"))


def ago(then: Column | str, now: Column) -> Column:
    """How long ago in words: never, just now, minutes, hours, days."""
    s = (F.unix_micros(now) - F.unix_micros(_col(then))) / 1_000_000
    whole = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(_col(then).isNull(), "never").when(s < 60, "just now").when(s < 3600, whole(60, "min")).when(s < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def allowed_distance(c: Column | str, cap: int = 2) -> Column:
    """Edits a term may differ by: none up to 3 characters, 1 up to 6, then 2."""
    n = F.length(_col(c))
    return F.least(F.when(n <= 3, 0).when(n <= 6, 1).otherwise(2), F.lit(min(cap, 2)))


def osa_distance(a: str, b: str, limit: int) -> int | None:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of
    neighbours, each character edited once; None above ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return None
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        if min(new) > limit:
            return None
        older, old = old, new
    return old[-1] if old[-1] <= limit else None


@F.pandas_udf(T.IntegerType())
def osa_distance_udf(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa_distance(x, y, int(n)) for x, y, n in zip(a, b, limit)], dtype="Int32")


def byte_truncate(text: str, limit: int) -> str:
    """The longest prefix of at most ``limit`` UTF-8 bytes."""
    return text.encode()[:limit].decode(errors="ignore")


@F.pandas_udf(T.StringType())
def byte_truncate_udf(text: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else byte_truncate(t, int(n)) for t, n in zip(text, limit)])
