"""Ranked retrieval over the index tables, for many queries at once.

Query terms are a small table; they meet the postings in an equi-join on (field,
term), so only matching postings are scored. Scores are summed per query and
document with map-side combination; top-k is a window per query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import MAX_TERM_CHARS, FUNCTION_WORDS, QUESTION_WORDS, allowed_distance, code_tokens, default_tokens, drop_stopwords, forced_symbols, osa_distance_udf, plain_text_query
from docquarry.operators.index import CODE_FIELDS, DICTIONARY_FIELDS, Index
from docquarry.runtime import cut, maybe_broadcast

#: Constants of BM25.
K1, B = 1.2, 0.75
PREFIX_CHARS = 3
#: Decimals of a score. Sums of floats differ in the last bits with the order of addition,
#: so equal documents are only tied once their scores are rounded.
SCORE_DECIMALS = 6


@dataclass(frozen=True)
class Ranking:
    """The tuned weights, and the untuned ones below."""

    boosts: dict[str, float] = field(default_factory=lambda: {"title": 0.5, "headers": 2.0, "body": 1.0, "code": 0.5, "symbol": 1.5})
    pivot: int = 4000
    penalty: float = 1.6
    stopwords: tuple[str, ...] = tuple(QUESTION_WORDS + FUNCTION_WORDS)
    corrected: float = 0.8
    max_distance: int = 2


TUNED = Ranking()
UNTUNED = Ranking({"title": 3.0, "headers": 2.0, "body": 1.0, "code": 1.5, "symbol": 0.0}, 0, 0.0, (), 0.0, 0)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def length_penalty(score: Column, length: Column, pivot: int, penalty: float) -> Column:
    """``score`` lowered for bodies longer than ``pivot``; pivot 0 leaves it."""
    if not pivot or not penalty:
        return score
    return F.when(length > pivot, score / (1 + penalty * F.log(length / pivot))).otherwise(score)


def query_terms(queries: DataFrame, ranking: Ranking = TUNED) -> DataFrame:
    """(query_id, field, term, weight) of plain queries: quotes aside, analysed per field
    and without stopwords; a term said twice weighs twice. ``@`` queries ask the
    declarations alone."""
    marked = queries.select("query_id", "q", forced_symbols("q").alias("at"))
    plain = marked.where((F.size("at") == 0) & F.col("q").isNotNull())
    text = plain_text_query("q")
    text = drop_stopwords(text, list(ranking.stopwords)) if ranking.stopwords else text
    cleaned = plain.select("query_id", F.regexp_replace(text, r'"[^"]*"', " ").alias("q"))
    per_field = [F.struct(F.lit(f).alias("field"), (F.array_distinct(F.transform(code_tokens("q"), lambda t: t["token"])) if f in CODE_FIELDS else default_tokens("q")).alias("terms"), F.lit(float(b)).alias("boost")) for f, b in ranking.boosts.items() if b]
    ordinary = cleaned.select("query_id", F.explode(F.array(*per_field)).alias("f")).select("query_id", "f.field", F.explode("f.terms").alias("term"), F.col("f.boost").alias("boost"))
    names = marked.where(F.size("at") > 0).select("query_id", F.explode("at").alias("s")).select("query_id", F.lit("declarations").alias("field"), F.explode(F.array_distinct(F.transform(code_tokens("s"), lambda t: t["token"]))).alias("term"), F.lit(1.0).alias("boost"))
    return ordinary.unionByName(names).groupBy("query_id", "field", "term").agg(F.sum("boost").alias("weight"))


def phrases(queries: DataFrame, ranking: Ranking = TUNED) -> DataFrame:
    """(query_id, phrase, field, term, slot, size, weight) of the quoted phrases."""
    text = plain_text_query("q")
    found = queries.where(F.size(forced_symbols("q")) == 0).select("query_id", F.explode(F.regexp_extract_all(text, F.lit('"([^"]+)"'))).alias("phrase"))
    cut = found.select("query_id", "phrase", default_tokens("phrase").alias("terms")).where(F.size("terms") > 0)
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(b)).alias("weight")) for f, b in ranking.boosts.items() if b and f not in CODE_FIELDS])).alias("f")
    return cut.select("query_id", "phrase", "terms", fields).select("query_id", "phrase", F.size("terms").alias("size"), "f.field", "f.weight", F.posexplode("terms").alias("slot", "term"))


def matched(index: Index, terms: DataFrame) -> DataFrame:
    """The postings of all terms asked for, read once and kept on shared storage."""
    return cut(index.lookup(maybe_broadcast(terms.select("field", "term").distinct())))


def _with_idf(index: Index, terms: DataFrame, found: DataFrame) -> DataFrame:
    """``terms`` that stand somewhere, with their idf."""
    freq = found.groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(index.stats.select("field", "n_docs")), "field")  # stats: one row per field
    return terms.join(freq, ["field", "term"]).withColumn("own_idf", idf(F.col("n_docs"), F.col("df"))).drop("n_docs", "df")


def _scored(index: Index, hits: DataFrame) -> DataFrame:
    """(query_id, key..., score) of hits (query_id, field, key..., tf, len, weight, term_idf)."""
    with_len = hits.join(F.broadcast(index.stats.select("field", "avg_len")), "field")
    part = F.col("weight") * F.col("term_idf") * bm25(F.col("tf"), F.col("len"), F.greatest("avg_len", F.lit(1e-9)))
    return with_len.groupBy("query_id", *index.key).agg(F.sum(part).alias("score"))


def term_scores(index: Index, terms: DataFrame, found: DataFrame) -> DataFrame:
    """Scores of single terms over their ``matched`` postings."""
    weighted = _with_idf(index, terms, found).withColumnRenamed("own_idf", "term_idf")
    return _scored(index, found.drop("positions").join(weighted, ["field", "term"]))


def phrase_scores(index: Index, asked: DataFrame, found: DataFrame) -> DataFrame:
    """A phrase counts where its terms stand at consecutive positions; its idf is the sum of theirs."""
    met = found.join(_with_idf(index, asked, found), ["field", "term"])
    starts = F.transform("positions", lambda p: p - F.col("slot"))
    whole = met.groupBy("query_id", "phrase", "field", *index.key).agg(F.collect_list(starts).alias("starts"), F.first("size").alias("size"), F.first("len").alias("len"), F.first("weight").alias("weight"), F.sum("own_idf").alias("term_idf")).where(F.size("starts") == F.col("size"))
    count = F.size(F.aggregate(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.col("starts")[0], lambda a, b: F.array_intersect(a, b)))
    return _scored(index, whole.withColumn("tf", count).where("tf > 0"))


def unknown_terms(terms: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, term) of dictionary-like query terms without any posting."""
    asked = terms.where(F.col("field").isin(*DICTIONARY_FIELDS) & (F.length("term") <= MAX_TERM_CHARS)).select("query_id", "term").distinct()
    return asked.join(found.select("term").distinct(), "term", "left_anti")


def corrections(index: Index, unknown: DataFrame, max_distance: int = TUNED.max_distance) -> DataFrame:
    """(query_id, typed, meant): for each unknown term the dictionary word with the same
    first three characters that is nearest, then most frequent, then first."""
    typed = unknown.select("query_id", F.col("term").alias("typed"), F.substring("term", 1, PREFIX_CHARS).alias("prefix"), allowed_distance("term", max_distance).alias("limit")).where("limit > 0")
    places = index.postings.select("field", "term", *index.key) if index.places is None else index.places.select("field", "term", *index.key)
    words = places.where(F.col("field").isin(*DICTIONARY_FIELDS)).withColumn("prefix", F.substring("term", 1, PREFIX_CHARS))
    near = words.join(maybe_broadcast(typed.select("prefix").distinct()), "prefix", "left_semi").distinct().groupBy("prefix", "term").agg(F.count("*").alias("df"))
    pairs = near.join(maybe_broadcast(typed), "prefix").where(F.abs(F.length("term") - F.length("typed")) <= F.col("limit"))
    measured = pairs.withColumn("distance", osa_distance_udf("term", "typed", "limit")).where("distance is not null")
    first = F.row_number().over(W.partitionBy("query_id", "typed").orderBy("distance", F.desc("df"), "term"))
    return measured.withColumn("n", first).where("n = 1").select("query_id", "typed", F.col("term").alias("meant"))


def highlight_terms(terms: DataFrame, corrected: DataFrame) -> DataFrame:
    """(query_id, terms): what to mark in a snippet, sorted and distinct."""
    every = terms.select("query_id", "term").unionByName(corrected.select("query_id", F.col("meant").alias("term")))
    return every.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def scores(index: Index, queries: DataFrame, ranking: Ranking = TUNED, scope: Column | None = None) -> DataFrame:
    """(query_id, key..., stored columns, score) of every document that matches a query: by its
    terms, its phrases and the corrections of words that stand nowhere. ``scope`` is a
    condition on the documents; statistics stay those of the whole index."""
    terms, said = cut(query_terms(queries, ranking)), phrases(queries, ranking)
    found = matched(index, terms.select("field", "term").unionByName(said.select("field", "term")))
    parts = term_scores(index, terms, found).unionByName(phrase_scores(index, said, found)) if said.take(1) else term_scores(index, terms, found)
    unknown = unknown_terms(terms, found) if ranking.corrected and ranking.max_distance else None
    if unknown is not None and unknown.take(1):
        fixed = corrections(index, unknown, ranking.max_distance).withColumnRenamed("typed", "term")
        meant = cut(terms.join(fixed, ["query_id", "term"]).select("query_id", "field", F.col("meant").alias("term"), (F.col("weight") * ranking.corrected).alias("weight")))
        parts = parts.unionByName(term_scores(index, meant, matched(index, meant)))
    docs = index.docs if scope is None else index.docs.where(scope)
    return parts.groupBy("query_id", *index.key).agg(F.sum("score").alias("score")).join(docs, list(index.key))


def search(index: Index, queries: DataFrame, limit: int = 10, ranking: Ranking = TUNED, scope: Column | None = None) -> DataFrame:
    """(query_id, hit_rank, key..., score) of the best ``limit`` documents of each query.

    ``scope`` is applied before the cut, so a scoped search is never short of hits.
    Scores are rounded to SCORE_DECIMALS and ties are broken by the key, so a result
    doesn't depend on the order of addition. Null and empty queries have no hits.
    """
    total = scores(index, queries, ranking, scope)
    size = F.col("body_chars" if "body_chars" in total.columns else "body_len")
    ranked = total.withColumn("score", F.round(length_penalty(F.col("score"), size, ranking.pivot, ranking.penalty), SCORE_DECIMALS))
    at = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), *index.key))
    return ranked.withColumn("hit_rank", at).where(F.col("hit_rank") <= max(limit, 1)).select("query_id", "hit_rank", *index.key, "score")


def total_hits(index: Index, queries: DataFrame, cap: int = 1000, ranking: Ranking = TUNED, scope: Column | None = None) -> DataFrame:
    """(query_id, total, total_capped): all hits of each query, with phrases, corrections and
    scope, counted up to ``cap``. A query without hits has no row."""
    n = scores(index, queries, ranking, scope).groupBy("query_id").agg(F.count("*").alias("n"))
    return n.select("query_id", F.least("n", F.lit(cap)).alias("total"), (F.col("n") >= cap).alias("total_capped"))


def with_totals(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """Hits with their query's ``total`` and whether the hits shown are fewer (``truncated``)."""
    shown = hits.groupBy("query_id").agg(F.count("*").alias("__shown"))
    known = totals.join(shown, "query_id").select("query_id", "total", "total_capped", (F.col("__shown") < F.col("total")).alias("truncated"))
    return hits.join(known, "query_id", "left")


def with_source_names(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with ``source_name``, the id where the source is unknown."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return hits.join(names, "source_id", "left").withColumn("source_name", F.coalesce("source_name", "source_id"))


def history(events: DataFrame, user: str, query: str, time: str, keep: int = 50, chars: int = 200) -> DataFrame:
    """Each user's last ``keep`` distinct queries, newest first; blank ones left out."""
    said = events.select(user, F.substring(F.trim(query), 1, chars).alias("q"), time).where("q <> ''").groupBy(user, "q").agg(F.max(time).alias("last_used"))
    at = F.row_number().over(W.partitionBy(user).orderBy(F.desc("last_used"), "q"))
    return said.withColumn("place", at).where(F.col("place") <= keep)
