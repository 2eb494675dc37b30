"""Source divergence audit with count-level bitmaps.

Within a language, every source's share of every kept term is compared with every
other source's and with the language's own.  A source's share of a term depends on
the term's count there alone, so a pair of sources needs only the joint cells of
counts: how many terms have count a in one and b in the other.  Term ids are dealt
into chunks; each (group, chunk, count) stores the bitset of its terms
(``levels``), and the AND of two bitsets and its popcount give a cell, which is
multiplied by the cell's value.  Terms that only one of the two has, or neither, come
by complement.  A level of few terms is stored as their ids and met one by one, as
that is smaller than its bitset.

Tokens are counted in Arrow batches and summed per (lang, source, term) before
anything meets.  Sources of a language are dealt into blocks of ``BLOCK``, and two
blocks meet once for each chunk of terms, so a task holds at most 2 * BLOCK sources of
about ``CHUNK`` terms.  Nothing but DataFrames passes between the steps.

Defined results: null text, lang and source count as empty; each row is a document,
repeated rows too; a document without terms still makes its group; a language without
kept terms has pair rows of value 0 and no term rows; other columns are ignored.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorlytics.llm.storage import drop, stored
from vendorlytics.llm.text import LOWER, Words, slices, text_bytes, tidied

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
CHUNK = 4096
BLOCK = 64
COUNT_BYTES = 16 << 20  # text whose tokens are counted together before they leave Python
# Term bytes: a-z (texts are lower-cased first) and all beyond ASCII.
SEPARATORS = np.ones(256, bool)
SEPARATORS[97:123] = SEPARATORS[128:] = False


# ------------------------------------------------------------------ counts

def _counted(piece: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some documents."""
    data, offsets = text_bytes(piece.column("text"))
    words = Words(LOWER[data], offsets, SEPARATORS)
    coded = words.array().dictionary_encode()
    width = max(1, len(coded.dictionary))
    doc = np.repeat(np.arange(piece.num_rows), words.counts())
    per_doc, n = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
    lang, source = (piece.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    key = group[per_doc // width] * width + per_doc % width
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    cells = key[starts]
    n = np.add.reduceat(n[order], starts) if len(key) else np.zeros(0, np.int64)
    g, term = cells // width, cells % width
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(g // max(1, len(source.dictionary)))),
         source.dictionary.take(pa.array(g % max(1, len(source.dictionary)))),
         pc.cast(coded.dictionary, pa.large_string()).take(pa.array(term)).cast(pa.string()),
         pa.array(n.astype(np.int64)), pa.array(np.diff(np.append(starts, len(key))).astype(np.int64))],
        ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", COUNT_BYTES):
                yield _counted(piece)

    rows = docs.mapInArrow(tidied(run), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly: longs where the
    product fits them, decimals beyond."""
    c, t, v = (F.col(x) if isinstance(x, str) else x for x in (count, total, terms))
    d = t + v
    small = F.call_function("div", (c + 1) * F.lit(SCALE), d)
    large = F.call_function("div", (c + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), d.cast("decimal(20,0)"))
    return F.lit(1) + F.when(c < (1 << 63) // SCALE - 1, small).otherwise(large)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


# ------------------------------------------------------------------ bitmaps

class Profile:
    """One source's terms in one chunk: the levels (counts) they have."""

    def __init__(self, width: int, zero: int):
        self.width, self.p, self.level = width, [zero], np.zeros(width, np.int32)
        self.dense, self.bits, self.sparse = [], [], []

    def add(self, p: int, held: bytes, dense: bool) -> None:
        k = len(self.p)
        self.p.append(p)
        if dense:
            ids = np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little"))
            self.dense.append(k)
            self.bits.append(np.frombuffer(held, np.uint64))
        else:
            ids = np.frombuffer(held, np.uint16)
            self.sparse.append(ids)
        self.level[ids] = k

    def close(self) -> Profile:
        self.p = np.array(self.p, np.int64)
        self.dense = np.array(self.dense, np.int64)
        self.bits = np.array(self.bits, np.uint64).reshape(len(self.dense), -(-self.width // 64))
        self.sizes = np.bincount(self.level, minlength=len(self.p))
        self.sparse = np.concatenate(self.sparse).astype(np.int64) if self.sparse else np.zeros(0, np.int64)
        return self


def container(ids: np.ndarray, width: int) -> tuple[bytes, bool]:
    """The smaller of a level's bitset (whole 64-bit words) and its 16-bit ids."""
    words = -(-width // 64)
    if 2 * len(ids) < 8 * words:
        return ids.astype(np.uint16).tobytes(), False
    marks = np.zeros(words * 64, np.uint8)
    marks[ids] = 1
    return np.packbits(marks, bitorder="little").tobytes(), True


def joint(a: Profile, b: Profile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joint cells of two sources in a chunk: (p of a, p of b, terms)."""
    both = np.bitwise_count(a.bits[:, None] & b.bits[None]).sum(-1, dtype=np.int64) if len(a.dense) and len(b.dense) \
        else np.zeros((len(a.dense), len(b.dense)), np.int64)
    one = np.union1d(a.sparse, b.sparse)  # met one by one
    x, y = a.level[one], b.level[one]
    only_a = a.sizes[a.dense] - both.sum(1) - np.bincount(x, minlength=len(a.p))[a.dense]
    only_b = b.sizes[b.dense] - both.sum(0) - np.bincount(y, minlength=len(b.p))[b.dense]
    neither = a.width - len(one) - both.sum() - only_a.sum() - only_b.sum()
    i, j = np.nonzero(both)
    pa_, pb = a.p, b.p
    return (np.concatenate([pa_[a.dense[i]], pa_[x], pa_[a.dense], np.full(len(only_b), pa_[0]), pa_[:1]]),
            np.concatenate([pb[b.dense[j]], pb[y], np.full(len(only_a), pb[0]), pb[b.dense], pb[:1]]),
            np.concatenate([both[i, j], np.ones(len(one), np.int64), only_a, only_b, [neither]]))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Neighbouring rows with equal ``keys`` as one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:]):
            now = tuple(batch.column(k)[i].as_py() for k in keys)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def levels(placed: DataFrame) -> DataFrame:
    """(lang, chunk, source, n, p, held, dense): the terms of every level of every
    source, from ``placed`` (lang, chunk, width, source, id, n, p)."""
    keys = ["lang", "chunk", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys):
            n, p, ids = (t.column(c).to_numpy() for c in ("n", "p", "id"))
            cuts = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
            width = t.column("width")[0].as_py()
            held = [container(x, width) for x in np.split(ids, cuts[1:])]
            m = len(cuts)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([t.column(k)[0].as_py()] * m, t.schema.field(k).type) for k in keys), pa.array(n[cuts]), pa.array(p[cuts]),
                 pa.array([h for h, _ in held], pa.binary()), pa.array([d for _, d in held])],
                ["lang", "chunk", "source", "n", "p", "held", "dense"])

    ordered = placed.repartition(*keys).sortWithinPartitions(*keys, "n", "id")
    return ordered.mapInArrow(tidied(run), "lang string, chunk int, source string, n long, p long, held binary, dense boolean")


def _meet(t: pa.Table) -> pa.RecordBatch:
    """Values of all pairs of sources of two blocks in one chunk, both ways."""
    profiles: dict[str, Profile] = {}
    side: dict[str, bool] = {}
    rows = t.select(["source", "mine", "n", "p", "width", "held", "dense"]).to_pylist()
    for r in rows:  # sorted by source and count: the empty level comes first
        if r["n"] == 0:
            profiles[r["source"]] = Profile(r["width"], r["p"])
            side[r["source"]] = r["mine"]
        else:
            profiles[r["source"]].add(r["p"], r["held"], r["dense"])
    for x in profiles.values():
        x.close()
    lang, same = t.column("lang")[0].as_py(), t.column("x")[0].as_py() == t.column("y")[0].as_py()
    names = list(profiles)
    out: list[tuple[str, str, int]] = []
    for i, a in enumerate(names):
        for b in names[:i]:
            if same or side[a] != side[b]:
                p, q, n = joint(profiles[a], profiles[b])
                square = (p - q) ** 2
                out += [(a, b, int((n * (square // q)).sum())), (b, a, int((n * (square // p)).sum()))]
    a, b, v = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(out), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(v, pa.int64())],
        ["lang", "source", "item", "value"])


def pair_values(bitmaps: DataFrame, empty: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language.

    ``bitmaps`` as from ``levels``; ``empty`` (lang, chunk, source, width, p, blocks)
    has a row for every source and chunk, with the share of a count of 0; ``langs``
    has the number of ``blocks`` of each language's sources."""
    keys = ["lang", "chunk", "x", "y"]
    full = bitmaps.join(langs.select("lang", "blocks"), "lang").select(
        "lang", "chunk", "source", "n", "p", F.lit(0).alias("width"), "held", "dense", "blocks")
    none = empty.select("lang", "chunk", "source", F.lit(0).cast("long").alias("n"), "p", "width",
                        F.lit(None).cast("binary").alias("held"), F.lit(False).alias("dense"), "blocks")
    rows = full.unionByName(none).withColumn("mine", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", "chunk", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
        "source", "mine", "n", "p", "width", "held", "dense")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys):
            yield _meet(t)

    parts = met.repartition(*keys).sortWithinPartitions(*keys, "source", "n") \
        .mapInArrow(tidied(run), "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


# ------------------------------------------------------------------ the audit

def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far every source of a language is
    from each other one (part ``pair``, item the other source, all ranks) and the
    terms it has more of than its language (part ``term``, the ``top`` first)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stored(term_counts(docs), "term-counts")
    groups = stored(docs.select("lang", "source").distinct(), "groups")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")) \
        .where(F.col("docs") >= min_docs).drop("docs")
    kept = stored(kept, "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    sources = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    langs = sources.join(sizes, "lang", "left").select(
        "lang", "blocks", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all", F.lit(0)).alias("all"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("terms", F.lit(0)) / CHUNK)).cast("int").alias("chunks"))
    langs = stored(langs, "langs")

    # Terms get an id within their chunk.
    chunk = F.pmod(F.xxhash64("term"), "chunks").cast("int")
    within = Window.partitionBy("lang", "chunk")
    ids = kept.join(langs.select("lang", "chunks"), "lang").withColumn("chunk", chunk).select(
        "lang", "term", "total", "chunk", (F.row_number().over(within.orderBy("term")) - 1).alias("id"),
        F.count("*").over(within).cast("int").alias("width"))
    ids = stored(ids, "term-ids")
    placed = stored(counts.drop("docs").join(ids, ["lang", "term"]), "placed-terms")
    sums = placed.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups_ = stored(groups.join(sums, ["lang", "source"], "left").join(langs, "lang").withColumn(
        "own", F.coalesce("own", F.lit(0))), "group-totals")
    shares = placed.join(groups_.select("lang", "source", "own", "terms", "all"), ["lang", "source"]) \
        .withColumn("p", share("n", "own", "terms"))

    widths = ids.groupBy("lang", "chunk").agg(F.first("width").alias("width"))
    chunks = langs.select("lang", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")) \
        .join(widths, ["lang", "chunk"], "left").select("lang", "chunk", F.coalesce("width", F.lit(0)).alias("width"))
    empty = groups_.join(chunks, "lang").select(
        "lang", "chunk", "source", "width", "blocks", F.when(F.col("own") + F.col("terms") > 0, share(F.lit(0).cast("long"), "own", "terms"))
        .otherwise(F.lit(1)).cast("long").alias("p"))
    bitmaps = stored(levels(shares.select("lang", "chunk", "width", "source", "id", "n", "p")), "bitmaps")
    pairs = pair_values(bitmaps, empty, langs).withColumn("part", F.lit("pair"))

    q = share("total", "all", "terms")
    more = shares.withColumn("q", q).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    out = stored(ranked.select("lang", "source", "part", "item", "value", "rank").unionByName(terms), "divergence")
    for used in (counts, groups, kept, langs, ids, placed, groups_, bitmaps):
        drop(used)
    return out
