"""Inverted index tables: postings, field lengths, statistics.

A stored index can grow by segments: a commit adds the documents of a small index
and takes out others, and writes nothing of what is held already. A segment counts
once its list of taken keys is written, which comes last, so a commit that died half
way is never read.

An index is four DataFrames that can be written as parquet and read again. A document's
postings are grouped where its tokens are, by one sort of an Arrow batch, so building
needs no shuffle. Every file of postings is sorted by
(field, term), so a lookup of few terms reads only the pages of each file that may hold
them. Files hold documents, not terms, so a term of every document fills no file alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import code_tokens, default_tokens
from docquarry.runtime import maybe_broadcast

#: Fields analysed as code, and those a dictionary word may come from.
CODE_FIELDS = ("code", "symbol", "declarations")
DICTIONARY_FIELDS = ("title", "headers", "body")
#: Terms up to which a lookup in a stored index is also a filter of the scan.
PUSHED_TERMS = 1000
#: Positions between two headings, so that no phrase spans them.
HEADING_GAP = 100


@dataclass
class Index:
    """``postings``: field, term, key..., tf, len (of the document's field, so that scoring
    joins no lengths), positions. ``lengths``: field, key..., len. ``stats``: field,
    n_docs, avg_len. ``docs``: key..., body_len, stored columns."""

    key: tuple[str, ...]
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    docs: DataFrame
    places: DataFrame | None = None

    def lookup(self, terms: DataFrame) -> DataFrame:
        """Postings of the distinct (field, term) rows of ``terms``. In an index that isn't
        stored only the tokens asked for are grouped."""
        if self.places is None:
            few = terms.limit(PUSHED_TERMS + 1).collect()
            named = self.postings
            if len(few) <= PUSHED_TERMS:  # a filter that reaches the scan
                named = named.where(F.col("term").isin(sorted({r.term for r in few})) & F.col("field").isin(sorted({r.field for r in few})))
            return named.join(terms, ["field", "term"])
        return _grouped(self.places.join(terms, ["field", "term"]), self.key)

    def save(self, path: str) -> None:
        """Write all tables, replacing older ones."""
        _by_term(self.postings).write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("lengths", "stats", "docs"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, key: Sequence[str] = ("source_id", "path")) -> Index:
        return Index(tuple(key), *(spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "stats", "docs")))


def _segments(spark: SparkSession, path: str) -> list[int]:
    """The committed segments of a stored index."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/gone")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    done = [s.getPath().getName().removeprefix("segment=") for s in files.listStatus(at) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(x) for x in done if x.isdigit())


def commit(path: str, added: Index | None = None, deleted: DataFrame | None = None) -> int:
    """Add a segment to the index stored at ``path`` (the first one makes it): the documents of
    ``added`` take the place of those of the same key, those of ``deleted`` (the key, or
    some of its columns, as a source's id for all its pages) go. Gives the segment's number.
    One writer at a time."""
    keyed = added.docs.select(*added.key) if added is not None else None
    spark = (keyed if keyed is not None else deleted).sparkSession
    n = max(_segments(spark, path), default=0) + 1
    if added is not None:
        _by_term(added.postings).write.mode("overwrite").parquet(f"{path}/postings/segment={n}")
        for name in ("lengths", "docs"):
            getattr(added, name).write.mode("overwrite").parquet(f"{path}/{name}/segment={n}")
    gone = keyed if deleted is None else deleted if keyed is None else keyed.unionByName(deleted, allowMissingColumns=True)
    gone.distinct().write.mode("overwrite").parquet(f"{path}/gone/segment={n}")
    return n


def load_segments(spark: SparkSession, path: str, key: Sequence[str] = ("source_id", "path")) -> Index:
    """The live documents of a stored index: those that no later segment took out."""
    held = _segments(spark, path)

    def read(name: str) -> DataFrame:
        return spark.read.option("basePath", f"{path}/{name}").option("mergeSchema", True).parquet(f"{path}/{name}").where(F.col("segment").isin(held))

    gone = read("gone")
    whole = gone.where(" and ".join(f"`{k}` is not null" for k in key)).groupBy(*key).agg(F.max("segment").alias("__gone"))
    first = gone.where(f"`{key[-1]}` is null").groupBy(key[0]).agg(F.max("segment").alias("__all")) if len(key) > 1 else None

    def live(df: DataFrame) -> DataFrame:
        out = df.join(maybe_broadcast(whole), list(key), "left").where(F.col("__gone").isNull() | (F.col("segment") >= F.col("__gone"))).drop("__gone")
        if first is not None:
            out = out.join(maybe_broadcast(first), key[0], "left").where(F.col("__all").isNull() | (F.col("segment") >= F.col("__all"))).drop("__all")
        return out.drop("segment")

    lengths = live(read("lengths"))
    stats = lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    return Index(tuple(key), live(read("postings")), lengths, stats, live(read("docs")))


#: Documents whose postings are grouped at once.
_STEP = 1024


def _postings(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """field, term, key..., tf, len and positions of rows (field, key..., tokens): the tokens of a
    batch are sorted by (row, term, position), and every run is a posting."""
    shape = ", ".join(["field string", "term string", *(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key), "tf int", "len int", "positions array<int>"])
    names = ["field", "term", *key, "tf", "len", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _STEP):
                b = whole.slice(start, _STEP)
                tokens = b.column("tokens")
                off = np.asarray(tokens.offsets)
                items = tokens.values.slice(off[0], off[-1] - off[0])
                sizes = np.diff(off)
                coded = items.field("token").dictionary_encode()
                row, code, pos = np.repeat(np.arange(b.num_rows), sizes), np.asarray(coded.indices).astype(np.int64), np.asarray(items.field("pos"))
                group = row * max(1, len(coded.dictionary)) + code
                order = np.lexsort((pos, group))
                group, pos = group[order], pos[order]
                first = np.flatnonzero(np.diff(group, prepend=-1))
                own = row[order[first]]
                ends = np.append(first, len(group)).astype(np.int32)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [b.column("field").take(at), coded.dictionary.take(pa.array(code[order[first]])), *(b.column(k).take(at) for k in key), pa.array(np.diff(ends)), pa.array(sizes[own].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos, pa.int32()))], names
                )

    return rows.select("field", *key, "tokens").mapInArrow(run, shape)


def _by_term(postings: DataFrame) -> DataFrame:
    """Postings as they are written: where the documents are, sorted. No shuffle, and no
    sampling that would group them twice."""
    return postings.sortWithinPartitions("field", "term")


def _grouped(places: DataFrame, key: Sequence[str]) -> DataFrame:
    return places.groupBy("field", "term", *key).agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"), F.sort_array(F.collect_list("pos")).alias("positions"))


def placed_tokens(text: Column) -> Column:
    """Default tokens of one text as (token, pos, len)."""
    return F.transform(default_tokens(text), lambda t, i: F.struct(t.alias("token"), i.alias("pos"), F.lit(1).alias("len")))


def placed_headings(headings: Column) -> Column:
    """Default tokens of several texts with a gap of positions between them."""
    return F.flatten(F.transform(headings, lambda h, k: F.transform(default_tokens(h), lambda t, i: F.struct(t.alias("token"), (i + k * HEADING_GAP).cast("int").alias("pos"), F.lit(1).alias("len")))))


def build(df: DataFrame, key: Sequence[str], fields: dict[str, Column], stored: dict[str, Column] | None = None, body: str = "body") -> Index:
    """Index the (token, pos, len) arrays of ``fields``. Null arrays count as empty;
    documents without tokens have length 0; keys should be distinct (rows of one key are
    postings of their own)."""
    empty = F.array().cast("array<struct<token:string,pos:int,len:int>>")
    per_field = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(c, empty).alias("tokens")) for n, c in fields.items()])).alias("f")
    rows = df.select(*key, per_field).select(*key, "f.field", "f.tokens")
    lengths = rows.select("field", *key, F.size("tokens").alias("len"))
    places = rows.select("field", *key, F.size("tokens").alias("len"), F.explode("tokens").alias("t")).select("field", *key, "len", F.col("t.token").alias("term"), F.col("t.pos").alias("pos"))
    stats = lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    docs = df.select(*key, F.size(F.coalesce(fields.get(body, empty), empty)).alias("body_len"), *[c.alias(n) for n, c in (stored or {}).items()])
    return Index(tuple(key), _postings(rows, key), lengths, stats, docs, places)


def build_pages(pages: DataFrame) -> Index:
    """Index of page fields (source_id, path, title, headers, body_text, code, symbol,
    symbol_kind, declarations, content_hash if there)."""
    fields = {
        "title": placed_tokens(F.col("title")),
        "headers": placed_headings(F.col("headers")),
        "body": placed_tokens(F.col("body_text")),
        "code": code_tokens(F.col("code")),
        "symbol": code_tokens(F.col("symbol")),
        "declarations": code_tokens(F.array_join("declarations", " ")),
    }
    stored = {c: F.col(c) for c in ("title", "symbol_kind", "content_hash") if c in pages.columns}
    return build(pages, ["source_id", "path"], fields, stored | {"body_chars": F.length("body_text")})
