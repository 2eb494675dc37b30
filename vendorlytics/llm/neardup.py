"""Near duplicates by MinHash: one-permutation hashing with optimal densification.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set holds
its distinct 5-word shingles (shorter texts: the whole sequence).  One hash deals
the shingles over ``BINS`` bins; a bin keeps its least value, and an empty bin
borrows from the first full bin of its own fixed probe sequence, the same for
all documents.  ``ROWS`` bins make a band, whose hash is a bucket.

Documents with equal sets form a class, known by its smallest id.  In a bucket,
every class is paired with one centre only (a star), so a bucket of n classes
costs n - 1 pairs, which are confirmed on the full sets.  The first centre is the
smallest class.  Where a bucket's classes aren't all connected then, further stars
follow around the class with the most confirmed links (the original of a family of
copies).  What is still apart is compared block by block: blocks of about
``BLOCK`` classes of a bucket meet each other with two bytes a shingle, whose
counts bound the intersection from above, and only pairs that may be similar by
that bound are confirmed.  So every pair that shares a bucket and isn't connected
otherwise is looked at, while no table holds a row for each of them.

Defined results: null or empty texts, or texts without words, have an empty set
and link with nothing; a row without id isn't linked and its component is null;
rows that share an id are one document for linking, and each keeps its own row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics.llm.components import components, joined, meetings, pair_batch
from vendorlytics.llm.storage import drop, stored
from vendorlytics.llm.text import LOWER, Words, mix, slices, text_bytes, tidied, window_hashes

SHINGLE = 5
SIMILAR = (75, 100)
BINS, ROWS = 384, 6
HUBS, BLOCK = 2, 256
EMPTY = np.uint64(2**64 - 1)
# Bin i tries bins start[i], start[i] + step[i], ...: steps are prime to BINS, so all are tried.
_steps = [s for s in range(1, BINS) if np.gcd(s, BINS) == 1]
_seed = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64))
_START = (_seed[:BINS] % np.uint64(BINS)).astype(np.int64)
_STEP = np.array(_steps)[(_seed[BINS:] % np.uint64(len(_steps))).astype(np.int64)]


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    words = Words(LOWER[data], offsets)
    hashes, first = words.hashes(), words.first
    runs = window_hashes(hashes, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(runs[a:b - width + 1])
        elif a < b:
            yield window_hashes(hashes[a:b], b - a)
        else:
            yield runs[:0]


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation signatures of non-empty sets, one row each."""
    out = np.full((len(sets), BINS), EMPTY)
    for row, s in enumerate(sets):
        h = np.sort(mix(s))
        bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))  # sorted: the first of a bin is its least
        out[row, bins[at]] = h[at]
    full = out != EMPTY
    rows, bins = np.nonzero(~full)
    turn = _START[bins]
    while len(rows):
        hit = full[rows, turn]
        out[rows[hit], bins[hit]] = out[rows[hit], turn[hit]]
        rows, bins, turn = rows[~hit], bins[~hit], turn[~hit]
        turn = (turn + _STEP[bins]) % BINS
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    bands = BINS // ROWS
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), bands))
    grouped = signatures.reshape(len(signatures), bands, ROWS)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands) of each row; set_hash and bands are
    null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text")))
                some = [i for i, s in enumerate(sets) if len(s)]
                bands, names = [None] * len(sets), [None] * len(sets)
                keys = band_keys(signature([sets[i] for i in some]))
                for k, i in enumerate(some):
                    bands[i] = keys[k]
                    names[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(names, pa.string()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_hash", "bands"])

    return docs.select("doc_id", "text").mapInArrow(
        tidied(run), "doc_id long, n_shingles long, set_hash string, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, set_hash, n, shingles, marks) of the classes in ``wanted`` (rep, set_hash); marks
    has two bytes of each shingle.  An id with different texts may stand for several
    classes: each of their sets counts, as they are one document for linking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                kept = [(rep, name, s) for rep, name, s in zip(
                    part.column("rep").to_pylist(), part.column("set_hash").to_pylist(),
                    shingle_sets(part.column("text")))
                    if hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() == name]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in kept], pa.int64()), pa.array([h for _, h, _ in kept], pa.string()),
                     pa.array([len(s) for _, _, s in kept], pa.int64()),
                     pa.array([s.astype("<u8").tobytes() for _, _, s in kept], pa.binary()),
                     pa.array([(s & np.uint64(65535)).astype("<u2").tobytes() for _, _, s in kept], pa.binary())],
                    ["rep", "set_hash", "n", "shingles", "marks"])

    rows = docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("rep", "set_hash", "text")
    return rows.mapInArrow(tidied(run), "rep long, set_hash string, n long, shingles binary, marks binary") \
        .dropDuplicates(["rep", "set_hash"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    least, of = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(left.as_buffer(), "<u8"), np.frombuffer(right.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(of * both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right") \
        .mapInArrow(tidied(run), "a long, b long").distinct()


def sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity (intersection <= the smaller set)."""
    least, of = SIMILAR
    out = pairs.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a") \
        .join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    return out.where(F.least("na", "nb") * of >= F.greatest("na", "nb") * least).select("a", "b").distinct()


def block_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of different labels in the same bucket that may be similar,
    from rows (bucket, rep, label, size, n, marks), size being the bucket's."""
    return meetings(rows, ["n", "marks"], BLOCK, _meeting)


def _meeting(rows: pa.Table) -> pa.RecordBatch:
    rep, label, n = (rows[c].to_numpy() for c in ("rep", "label", "n"))
    least, of = SIMILAR
    cells = 2048 if n.max() <= 1024 else 16384
    marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), "<u2").astype(np.int64) % cells
    table = np.bincount(np.repeat(np.arange(len(n)), n) * cells + marks, minlength=len(n) * cells) \
        .astype(np.uint16 if n.max() < 65536 else np.int64).reshape(-1, cells)
    a, b = [], []
    for i in range(len(rep) - 1):
        fewer, more = np.minimum(n[i], n[i + 1:]), np.maximum(n[i], n[i + 1:])
        maybe = np.flatnonzero((label[i + 1:] != label[i]) & (fewer * of >= more * least)) + i + 1
        if len(maybe):
            both = np.minimum(table[maybe], table[i]).sum(1, dtype=np.int64)  # at least the true intersection
            maybe = maybe[both * of >= least * (n[i] + n[maybe] - both)]
            a.append(np.minimum(rep[i], rep[maybe]))
            b.append(np.maximum(rep[i], rep[maybe]))
    return pair_batch(a, b)


def link(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    sketched = stored(sketch(docs), "sketches")
    classes = sketched.where("doc_id IS NOT NULL AND set_hash IS NOT NULL") \
        .groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    members = stored(sketched.drop("bands").join(classes, "set_hash", "left"), "members")
    first = members.where("doc_id = rep").select("doc_id", "set_hash").distinct()
    reps = stored(sketched.join(first, ["doc_id", "set_hash"], "left_semi")
                  .dropDuplicates(["doc_id", "set_hash"])
                  .select(F.col("doc_id").alias("rep"), "set_hash", F.col("n_shingles").alias("n"), "bands"), "classes")
    # Rows that share an id tie their classes together.
    ties = members.where("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id") \
        .agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all")).where(F.size("all") > 1) \
        .select("a", F.explode("all").alias("b")).where("a != b")
    drop(sketched)

    buckets = reps.select("rep", F.explode("bands").alias("bucket")).distinct()
    centres = buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("size")).where("size > 1")
    shared = stored(buckets.join(centres, "bucket").select("bucket", "rep", "centre", "size"), "buckets")
    sizes = stored(reps.select("rep", "n"), "sizes")
    sets = stored(full_sets(docs, reps.select("rep", "set_hash").join(
        shared.select("rep").distinct(), "rep", "left_semi")), "sets")
    drop(reps)
    stars = shared.where("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    tested = stored(sized(stars, sizes), "pairs")
    links = stored(confirm(tested, sets).unionByName(ties), "links")
    labels, before, used = components(links), None, [sets, sizes, shared, tested, links]
    for turn in range(HUBS + 1):
        if labels is not before:
            named = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left") \
                .withColumn("label", F.coalesce("label", "rep"))
            apart = named.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l != m").select("bucket")
            named = stored(named.join(apart, "bucket", "left_semi"), "apart")
            used.append(named)
        elif turn < HUBS:
            continue  # no link was new: the same hubs again
        before = labels
        if turn < HUBS:
            degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
            hubs = named.join(degree, "rep").groupBy("bucket").agg(F.max(F.struct("degree", "rep", "label")).alias("hub")) \
                .select("bucket", F.col("hub.rep").alias("hub"), F.col("hub.label").alias("hub_label"))
            more = named.join(hubs, "bucket").where("label != hub_label") \
                .select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
            more = sized(more, sizes)
        else:
            more = block_pairs(named.join(sets.select("rep", "n", "marks"), "rep"))
        more = stored(more.join(tested, ["a", "b"], "left_anti"), "more-pairs")
        new = stored(confirm(more, sets), "links")
        labels, links, tested = joined(labels, new), links.unionByName(new), tested.unionByName(more)
        used += [more, new]
    for table in used:
        drop(table)

    out = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
