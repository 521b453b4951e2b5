"""Subjects of documents, by label propagation over a document-similarity graph.

1. The graph. Two documents are linked by every pair of associated terms that both
   hold. A link is verified: the two terms must stand together in documents far
   more often than chance, by a likelihood ratio over the whole collection, and
   about as often as each of them does with its closest partner. A word that is
   merely frequent, or two that meet by accident, link nothing.
2. The documents of one pair are all linked to each other. Such a clique of n is
   carried as a hub with n spokes, as anchor graphs do: what a document receives
   over its n - 1 links is the hub's sum without its own share, to the last count,
   and the n * n links are never written. A hub with a third of all documents is a
   row like any other.
3. Propagation, ROUNDS times. Labels are summed per hub (each batch on its own,
   then a map-side combined aggregation), and every document weighs what its hubs
   say. The first round hears the annotated documents, later ones all documents.
   A term's weight for a subject is that subject's share of what came in over the
   term's hubs, shrunk where few documents spoke. Hubs in which no subject leads
   among the annotated documents tell nothing and are left out.
4. A label is verified: enough distinct terms and a share of the text, so that a
   passing mention isn't one. Weights are kept per term, so a document's second
   subject doesn't drown in the links of its first. Trusted seeds, those whose own
   links support them at least weakly, are clamped in every round; the others are
   labelled like any document.

What reaches the driver is bounded whatever the number of documents: terms in at
least LEAST_TERM of them (mean terms of a text / LEAST_TERM at most), associated pairs
in at least LEAST_PAIR of them (mean pairs of a text / LEAST_PAIR at most; above MAX_HUBS the job
ends with an error instead of dropping any) and the subjects' sums over those pairs.

Defined results: null and empty texts have no subject; repeated labels count once;
labels of subjects that aren't listed are ignored; each text of a repeated id is
judged for itself, and the id has the subjects of all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.words import folded_form
from docquarry.runtime import cut, maybe_broadcast

ROUNDS = 3
#: Shares of the documents between which a term may link, and up to which it may if the
#: annotated documents lean to a subject with it; least share of a pair's documents.
LEAST_TERM, MOST_TERM, LEANING_TERM, LEAST_PAIR = 0.002, 0.12, 0.5, 0.0004
#: How much more often than by chance a leaning term goes with its subject, and the
#: likelihood ratio of that; far fewer terms than pairs are tried, so it is lower than a pair's.
LEAN, LEAN_RATIO = 1.5, 8.0
#: z of the upper bound of a subject's share of a term; a term that can't reach MIN_WEIGHT links nothing.
LEAD_Z = 2.0
#: Least documents of a term and of a pair, and least likelihood ratio and lift of a pair.
TERM_DOCS, PAIR_DOCS, LEAST_RATIO, LEAST_LIFT = 5, 3, 15.0, 2.0
#: Least part of the closest partner's lift.
NEAR_LIFT = 0.25
#: Associated pairs up to which the hubs travel.
MAX_HUBS = 4_000_000
#: Annotated documents from which a hub is judged, and what a subject must hold of them.
HUB_DOCS, HUB_LEAD = 4, 0.5
#: Shrinkage of a term's weight, its least weight, and its least part of the term's weight
#: for the subject it speaks for most: subjects that often go together don't share terms.
SHRINK, MIN_WEIGHT, NEAR_WEIGHT = 3.0, 0.6, 0.75
#: A label needs this weight of distinct terms, and this share of the text's words.
MIN_SCORE, MIN_DENSITY = 1.3, 0.008
#: Weight of distinct terms from which a seed is trusted.
TRUST_SCORE = 1.0

_CASE = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")


#: ASCII: letters and digits kept, all else to a space.
_ASCII = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_RUNS = re.compile(r"[^\W_]+")
_KNOWN: dict[str, tuple[int, tuple[str, ...]]] = {}


def _parts(run: str) -> tuple[int, tuple[str, ...]]:
    """Words and terms of one run of letters and numbers."""
    found = _CASE.sub(" ", run).lower().split()
    own = [w[:-1] if w[-1] == "s" and len(w) > 4 else w for w in found if len(w) > 2 and not w[0].isdigit()]
    return len(found), tuple(own)


def terms(text: str | None) -> tuple[int, dict[str, int]]:
    """Number of words, and the terms with their occurrences: compound identifiers are
    split, a plural s is dropped, one- and two-letter words and numbers left out."""
    if not text:
        return 0, {}
    if not text.isascii():
        text = folded_form(text)
    runs = Counter(text.encode().translate(_ASCII).decode().split() if text.isascii() else _RUNS.findall(text))
    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    total, n = 0, {}
    for run, times in runs.items():
        known = _KNOWN.get(run)
        if known is None:
            known = _KNOWN[run] = _parts(run)
        total += known[0] * times
        for w in known[1]:
            n[w] = n.get(w, 0) + times
    return total, n


_HASHES: dict[str, int] = {}


def _hashes(names) -> list[int]:
    """32-bit hashes: of the few thousand terms that may link, two agree falsely once in
    some hundred collections."""
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    get, out = _HASHES.get, []
    for w in names:
        h = get(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh32_intdigest(w) - (1 << 31)
        out.append(h)
    return out


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a list column without nulls."""
    off = np.asarray(col.offsets)
    return np.asarray(col.values)[off[0] : off[-1]], np.diff(off)


def _term_rows(docs: DataFrame) -> DataFrame:
    """One row per document: its words, hashed terms and their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, hashed, counts, sizes = [], [], [], []
            for text in b.column(1).to_pylist():
                n, own = terms(text)
                n_words.append(n)
                hashed += _hashes(own)
                counts += own.values()
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int32()), _lists(np.array(hashed, np.int32), np.array(sizes, np.int64), pa.int32()), _lists(np.array(counts, np.int32), np.array(sizes, np.int64), pa.int32())], ["doc", "n_words", "terms", "counts"])

    return docs.mapInArrow(run, "doc long, n_words int, terms array<int>, counts array<int>")


_TRIANGLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Pairs that are formed at once, so that a very long text takes no more memory.
_BLOCK = 2_000_000


def _pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j below ``n``, in blocks."""
    if n <= 64:
        if n not in _TRIANGLES:
            _TRIANGLES[n] = np.triu_indices(n, 1)
        yield _TRIANGLES[n]
        return
    step = max(1, _BLOCK // n)
    for start in range(0, n, step):
        i = np.arange(start, min(start + step, n))
        size = n - 1 - i
        j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(i + 1, size)
        yield np.repeat(i, size), j


class Band:
    """The terms that may link, sorted by hash; their place is their number."""

    def __init__(self, hashes: np.ndarray, n_docs: np.ndarray, total: int) -> None:
        order = np.argsort(hashes)
        self.hashes, self.n_docs, self.total = hashes[order], n_docs[order], total

    def own(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``flat`` of the terms that may link, their numbers, and how many each document has."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, flat), len(self.hashes) - 1)
        kept = np.flatnonzero(self.hashes[at] == flat)
        row = np.repeat(np.arange(len(sizes)), sizes)
        return kept, at[kept], np.bincount(row[kept], minlength=len(sizes))

    def pair_keys(self, numbers: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, keys of the term pairs) of documents, in blocks; a key is lower * terms + higher."""
        ends = np.cumsum(sizes)
        for row in np.flatnonzero(sizes > 1).tolist():
            own = np.sort(numbers[ends[row] - sizes[row] : ends[row]])
            for i, j in _pairs(len(own)):
                yield row, own[i] * len(self.hashes) + own[j]


def _ratio(n, e):
    """Likelihood ratio of ``n`` events where ``e`` are expected."""
    return 2 * (n * F.log(n / e) - n + e)


def _band(rows: DataFrame, seeds: DataFrame, total: int) -> Band:
    """Terms that may carry a label: not rare, and neither frequent nor found without a
    leading subject by the annotated documents; of the frequent ones those that lean to a
    subject, for one subject may fill a third of the collection."""
    seen = cut(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n").between(max(TERM_DOCS, LEAST_TERM * total), LEANING_TERM * total)))
    told = rows.join(maybe_broadcast(seeds), "doc").select("seeds", F.explode("terms").alias("term")).join(F.broadcast(seen), "term")  # at most mean terms of a text / LEAST_TERM rows
    every = F.concat(F.array(F.lit(-1)), "seeds")
    counts = cut(told.select("term", F.explode(every).alias("no")).groupBy("term", "no").agg(F.count("*").alias("k")))
    with_term = counts.where("no < 0").select("term", F.col("k").alias("m"))
    base = seeds.select(F.explode("seeds").alias("no")).groupBy("no").agg((F.count("*") / F.lit(float(max(1, seeds.count())))).alias("share"))
    per = counts.where("no >= 0").join(with_term, "term").join(F.broadcast(base), "no").withColumn("e", F.col("m") * F.col("share"))  # one row per subject
    p, m, z = F.col("k") / F.col("m"), F.col("m"), LEAD_Z
    most = (p + z * z / (2 * m) + z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    leaning = (F.col("k") >= LEAN * F.col("e")) & (_ratio(F.col("k"), F.col("e")) >= LEAN_RATIO)
    judged = per.groupBy("term").agg(F.max(most).alias("most"), F.max(leaning).alias("leaning"))
    often = F.col("n") > MOST_TERM * total
    some = seen.join(judged, "term", "left").where(F.when(often, F.coalesce("leaning", F.lit(False))).otherwise(F.coalesce("most", F.lit(1.0)) >= MIN_WEIGHT)).select("term", "n").toArrow()
    return Band(np.asarray(some.column(0).combine_chunks()).astype(np.int32), np.asarray(some.column(1).combine_chunks()).astype(np.int64), total)


def _counted(keys: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names)


def _pair_counts(rows: DataFrame, band: Band) -> DataFrame:
    """(pair, n): documents that hold both terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            _, numbers, sizes = band.own(*_flat(b.column(0)))
            for _, keys in band.pair_keys(numbers, sizes):
                held.append(keys)
                size += len(keys)
                if size > _BLOCK:
                    yield _counted(held, ["pair", "n"])
                    held, size = [], 0
        yield _counted(held, ["pair", "n"])

    return rows.select("terms").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _associated(pairs: DataFrame, band: Band, total: int, meeting: float) -> DataFrame:
    """(pair, n) of the terms that stand together far more often than chance."""
    spark, v = pairs.sparkSession, len(band.hashes)
    table = spark.createDataFrame(pa.table({"t": np.arange(v), "f": band.n_docs.astype(np.float64)})) if v else spark.createDataFrame([], "t long, f double")
    low, high = (F.broadcast(table.select(F.col("t").alias(x), F.col("f").alias(f"f{x}"))) for x in ("a", "b"))  # at most mean terms of a text / LEAST_TERM rows
    some = pairs.where(F.col("n") >= max(PAIR_DOCS, LEAST_PAIR * total)).select("pair", "n", F.expr(f"pair div {max(v, 1)}").alias("a"), F.expr(f"pair % {max(v, 1)}").alias("b"))
    # two terms meet in n documents of m terms each by chance: fa * fb * sum(m * m) / sum(m) ** 2
    chance = some.join(low, "a").join(high, "b").withColumn("e", F.least("fa", "fb", F.col("fa") * F.col("fb") * F.lit(meeting)))
    found = cut(chance.withColumn("lift", F.col("n") / F.col("e")).where((F.col("lift") >= LEAST_LIFT) & (_ratio(F.col("n"), F.col("e")) >= LEAST_RATIO)).select("pair", "n", "a", "b", "lift"))
    best = found.select(F.explode(F.array("a", "b")).alias("t"), "lift").groupBy("t").agg(F.max("lift").alias("m"))
    most = [F.broadcast(best.select(F.col("t").alias(x), F.col("m").alias(f"m{x}"))) for x in ("a", "b")]  # one row per term, as above
    return found.join(most[0], "a").join(most[1], "b").where(F.col("lift") >= NEAR_LIFT * F.greatest("ma", "mb")).select("pair", "n")


class Hubs:
    """Associated pairs sorted by key; a hub's place is its number."""

    def __init__(self, band: Band, keys: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(keys)
        self.band, self.keys, self.n = band, keys[order], n[order]
        self.low, self.high = self.keys // max(1, len(band.hashes)), self.keys % max(1, len(band.hashes))

    def kept(self, which: np.ndarray) -> Hubs:
        return Hubs(self.band, self.keys[which], self.n[which])

    def of(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hub numbers of documents, and how many each has."""
        found, count = [], np.zeros(len(sizes), np.int64)
        if len(self.keys):
            for row, keys in self.band.pair_keys(numbers, sizes):
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                own = at[self.keys[at] == keys]
                count[row] += len(own)
                found.append(own)
        return np.concatenate(found) if found else np.zeros(0, np.int64), count


class Sums:
    """What the hubs' documents say: for each hub the documents heard, and a list of
    (subject, documents) entries."""

    def __init__(self, heard: np.ndarray, hub: np.ndarray, subject: np.ndarray, k: np.ndarray) -> None:
        order = np.argsort(hub, kind="stable")
        self.heard, self.subject, self.k = heard, subject[order], k[order]
        self.off = np.searchsorted(hub[order], np.arange(len(heard) + 1))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), np.bool_)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def received(hubs: Hubs, sums: Sums, row: np.ndarray, hub: np.ndarray, own: np.ndarray, heard: np.ndarray, n_subjects: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, subject, weight): each term's share of every subject in what comes in
    over a document's links, without the document itself.

    ``row`` and ``hub`` are the spokes, ``own`` the documents' labels as sorted
    row * n_subjects + subject, ``heard`` whether a document was counted itself."""
    v = max(1, len(hubs.band.hashes))
    others = sums.heard[hub] - heard[row]
    live = others > 0
    row, hub, others = row[live], hub[live], others[live]
    ends = np.concatenate([row * v + hubs.low[hub], row * v + hubs.high[hub]])
    place, at = np.unique(ends, return_inverse=True)
    total = np.bincount(at, np.concatenate([others, others]), len(place))
    size = sums.off[hub + 1] - sums.off[hub]
    entry = _spread(sums.off[hub], size)
    of = np.repeat(np.arange(len(hub)), size)
    subject = sums.subject[entry]
    k = sums.k[entry] - _member(row[of] * n_subjects + subject, own)
    both = np.concatenate([at[: len(hub)][of] * n_subjects + subject, at[len(hub) :][of] * n_subjects + subject])
    key, where = np.unique(both, return_inverse=True)
    weight = np.bincount(where, np.concatenate([k, k]), len(key)) / (total[key // n_subjects] + SHRINK)
    spot = place[key // n_subjects]
    return spot // v, spot % v, key % n_subjects, weight


class Judge:
    """One round: the labels of a batch of compact rows by what their hubs say."""

    def __init__(self, hubs: Hubs, sums: Sums, n_subjects: int) -> None:
        self.hubs, self.sums, self.n = hubs, sums, n_subjects

    def labels(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, subject, score, density, whether it is a seed), sorted by row and subject."""
        rows, v = np.arange(b.num_rows), max(1, len(self.hubs.band.hashes))
        hub, sizes = _flat(b.column("hubs"))
        number, counts = _flat(b.column("numbers"))
        spots, occ = np.repeat(rows, counts) * v + number, _flat(b.column("counts"))[0]
        order = np.argsort(spots)
        spots, occ = spots[order], occ[order]
        seed, own = (np.unique(np.repeat(rows, n) * self.n + x) for x, n in map(_flat, (b.column("seeds"), b.column("labels"))))
        r, t, s, w = received(self.hubs, self.sums, np.repeat(rows, sizes), hub.astype(np.int64), own, np.asarray(b.column("heard").cast(pa.int8())).astype(np.int64), self.n)
        most = np.zeros(len(r))
        if len(r):  # terms come in runs
            first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])]))
            most = np.repeat(np.maximum.reduceat(w, first), np.diff(np.append(first, len(r))))
        on = w >= np.maximum(MIN_WEIGHT, NEAR_WEIGHT * most)
        r, t, s, w = r[on], t[on], s[on], w[on]
        key, at = np.unique(r * self.n + s, return_inverse=True)
        score = np.bincount(at, w, len(key))
        said = occ[np.searchsorted(spots, r * v + t)] if len(r) else np.zeros(0)
        density = np.bincount(at, w * said, len(key)) / np.maximum(1, np.asarray(b.column("n_words"))[key // self.n])
        is_seed = _member(key, seed)
        good = ((score >= MIN_SCORE) & (density >= MIN_DENSITY)) | (is_seed & (score >= TRUST_SCORE))
        return key[good] // self.n, key[good] % self.n, score[good], density[good], is_seed[good]


def _hub_sums(rows: DataFrame, n_subjects: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hub, subject, documents) of the current labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            hub, sizes = _flat(b.column("hubs"))
            subject, labels = _flat(b.column("labels"))
            row = np.repeat(np.arange(b.num_rows), labels)
            start = np.cumsum(sizes) - sizes
            spokes = hub[_spread(start[row], sizes[row])].astype(np.int64)
            yield _counted([spokes * n_subjects + np.repeat(subject, sizes[row])], ["entry", "n"])

    summed = rows.select("hubs", "labels").mapInArrow(run, "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    entry, n = (np.asarray(c.combine_chunks()).astype(np.int64) for c in summed.columns)
    return entry // n_subjects, entry % n_subjects, n


#: Documents that are judged at once.
_STEP = 1024


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, _STEP):
            yield whole.slice(start, _STEP)


def compact_rows(rows: DataFrame, hubs) -> DataFrame:
    """(doc, n_words, seeds, numbers, counts, hubs): a document's spokes and the terms at their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hubs.value
        for b in _slices(batches):
            at, numbers, sizes = known.band.own(*_flat(b.column("terms")))
            hub, n = known.of(numbers, sizes)
            counts = _flat(b.column("counts"))[0][at]
            # only terms at the end of a spoke are kept
            v = max(1, len(known.band.hashes))
            row = np.repeat(np.arange(b.num_rows), n)
            ends = np.unique(np.concatenate([row * v + known.low[hub], row * v + known.high[hub]]))
            on = _member(np.repeat(np.arange(b.num_rows), sizes) * v + numbers, ends)
            kept = np.bincount(np.repeat(np.arange(b.num_rows), sizes)[on], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("n_words"), b.column("seeds"), _lists(numbers[on], kept, pa.int32()), _lists(counts[on], kept, pa.int32()), _lists(hub, n, pa.int32())], ["doc", "n_words", "seeds", "numbers", "counts", "hubs"])

    made = rows.mapInArrow(run, "doc long, n_words int, seeds array<int>, numbers array<int>, counts array<int>, hubs array<int>")
    return made.where(F.size("hubs") > 0)


def subjects(docs: DataFrame, labels: DataFrame, listed: DataFrame, doc_id: str = "doc_id", text: str = "text", subject: str = "subject", rounds: int = ROUNDS) -> DataFrame:
    """(doc, subject, score, density, seed) of the subjects each document is about."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    names = sorted(r[0] for r in listed.select(F.col(subject).cast("string")).distinct().dropna().collect())  # the list of subjects
    n_subjects = max(1, len(names))
    numbered = F.broadcast(spark.createDataFrame(list(enumerate(names)), "subject_no int, subject string"))
    given = labels.select(F.col(doc_id).cast("long").alias("doc"), F.col(subject).alias("subject")).dropna().join(numbered, "subject")
    seeds = cut(given.groupBy("doc").agg(F.sort_array(F.collect_set("subject_no")).alias("seeds")))

    rows = cut(_term_rows(d).where(F.size("terms") > 0))
    size = F.size("terms").cast("double")
    total, squares, all_terms = rows.agg(F.count("*"), F.coalesce(F.sum(size * size), F.lit(0.0)), F.coalesce(F.sum(size), F.lit(1.0))).first()
    band = _band(rows, seeds, total)
    pairs = cut(_associated(_pair_counts(rows, band), band, total, squares / all_terms**2))
    if pairs.count() > MAX_HUBS:
        raise ValueError(f"more than {MAX_HUBS} associated pairs: raise LEAST_PAIR or LEAST_LIFT")
    found = pairs.toArrow()
    every = Hubs(band, *(np.asarray(c.combine_chunks()).astype(np.int64) for c in found.columns))

    # what the annotated documents say, and the hubs in which they agree on nothing
    seeded = maybe_broadcast(seeds)
    annotated = compact_rows(rows.join(seeded, "doc"), spark.sparkContext.broadcast(every)).withColumn("labels", F.col("seeds"))
    hub, no, k = _hub_sums(annotated, n_subjects)
    heard = _heard(annotated, len(every.keys))
    lead = np.zeros(len(every.keys), np.int64)
    np.maximum.at(lead, hub, k)
    keep = (heard < HUB_DOCS) | (lead >= HUB_LEAD * heard)
    hubs, moved = every.kept(keep), np.cumsum(keep) - 1
    at = keep[hub]
    sums = Sums(heard[keep], moved[hub[at]], no[at], k[at])

    unseeded = F.coalesce("seeds", F.array().cast("array<int>"))
    made = compact_rows(rows.join(seeded, "doc", "left").withColumn("seeds", unseeded), spark.sparkContext.broadcast(hubs))
    graph = cut(made.select("*", F.col("seeds").alias("labels"), (F.size("seeds") > 0).alias("heard")))
    for _ in range(rounds - 1):
        graph = cut(_relabelled(graph, spark.sparkContext.broadcast(Judge(hubs, sums, n_subjects))))
        sums = Sums(hubs.n, *_hub_sums(graph, n_subjects))
    judge = spark.sparkContext.broadcast(Judge(hubs, sums, n_subjects))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = judge.value
        for b in _slices(batches):
            row, subject_no, score, density, seed = ready.labels(b)
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(row)), pa.array(subject_no.astype(np.int32)), pa.array(score, pa.float64()), pa.array(density, pa.float64()), pa.array(seed, pa.bool_())], ["doc", "subject_no", "score", "density", "seed"])

    told = graph.mapInArrow(final, "doc long, subject_no int, score double, density double, seed boolean").join(numbered, "subject_no")
    return told.groupBy("doc", "subject").agg(F.max("score").alias("score"), F.max("density").alias("density"), F.max("seed").alias("seed"))


def _relabelled(rows: DataFrame, judge) -> DataFrame:
    """The same rows with the labels of one more round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = judge.value
        for b in _slices(batches):
            row, subject_no, *_ = ready.labels(b)
            labels = _lists(subject_no, np.bincount(row, minlength=b.num_rows), pa.int32())
            yield b.set_column(b.schema.get_field_index("labels"), "labels", labels).set_column(b.schema.get_field_index("heard"), "heard", pa.array(np.ones(b.num_rows, np.bool_)))

    return rows.mapInArrow(run, rows.schema)


def _heard(rows: DataFrame, n_hubs: int) -> np.ndarray:
    """Documents of every hub."""
    got = rows.select(F.explode("hubs").alias("hub")).groupBy("hub").agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(n_hubs, np.int64)
    if got.num_rows:
        out[np.asarray(got.column(0).combine_chunks())] = np.asarray(got.column(1).combine_chunks())
    return out
