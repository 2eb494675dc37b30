"""Line deduplication by a segment-partition edit join.

Lines are the ``\\n``-parts of a text.  Two different lines of at least ``NEAR``
characters are linked if at most ``EDITS`` insertions, deletions or substitutions
of characters turn one into the other; linked lines and equal lines make classes.
Every line whose class occurs earlier (smaller id, or same document and earlier
line) is removed.  Lines without a word are never removed.

The join: a line is cut into ``EDITS + 1`` segments of even length.  At most
``EDITS`` edits leave one segment of the shorter line whole, so the longer line
holds it, shifted by no more than the edits on either side allow.  Buckets are
(length, segment number, content): a line is filed under its own segments and
under its substrings at the allowed shifts for the lengths down to ``EDITS``
less.  Pairs within a bucket are stars (``components.connect``) and are confirmed
by a banded bit-parallel edit distance on the whole lines.

Defined results: null and empty texts have one empty line, which stays; a null id
comes before all others; rows that share id and text are one document and each
gets its result; of different texts that share an id, the one with the smaller
hash is the earlier; lines whose 64-bit hash doesn't tell them apart (seen by a
second hash) stay; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics.llm.components import connect, meetings, pair_batch
from vendorlytics.llm.edit import within
from vendorlytics.llm.passages import keyed
from vendorlytics.llm.storage import drop, stored
from vendorlytics.llm.text import SPACES, hash_spans, mix, slices, span_sums, text_bytes, tidied

EDITS = 2
NEAR = 24
BLOCK, CELLS, PAIRS = 256, 128, 1024
FILED = 1 << 20
OCCURRENCE = "ord long, k long, no int"


class Lines:
    """The lines with a word of some texts: their place in the bytes, text and number."""

    def __init__(self, column: pa.Array):
        self.data, offsets = text_bytes(column)
        feed = np.flatnonzero(self.data == 10)
        begins = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], feed + 1]))
        begins = begins[begins < len(self.data)]
        doc = np.searchsorted(offsets, begins, side="right") - 1
        ends = np.minimum(np.append(feed, len(self.data))[np.searchsorted(feed, begins)], offsets[1:][doc])
        solid = np.append(0, np.cumsum(~SPACES[self.data]))
        first = np.append(0, np.cumsum(self.data == 10))
        no = first[begins] - first[offsets[:-1][doc]]
        some = solid[ends] > solid[begins]
        self.begin, self.end, self.doc, self.no = begins[some], ends[some], doc[some], no[some].astype(np.int32)
        self.sums = span_sums(self.data)
        self.hash = hash_spans(self.sums, self.begin, self.end)


def occurrences(docs: DataFrame) -> DataFrame:
    """(line, check, ord, k, no) of every line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = Lines(part.column("text"))
                sizes = (x.end - x.begin).astype(np.uint64)
                # The second hash: of the bytes in another order, their halves' hashes swapped, and the length.
                half = (x.begin + x.end) // 2
                check = mix(hash_spans(x.sums, half, x.end) * np.uint64(0x9E3779B97F4A7C15)
                            + hash_spans(x.sums, x.begin, half) + sizes)
                ord_, k = part.column("ord").to_numpy(), part.column("k").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (x.hash.view(np.int64), check.view(np.int64), ord_[x.doc], k[x.doc], x.no)],
                    ["line", "check", "ord", "k", "no"])

    return docs.select("ord", "k", "text").mapInArrow(tidied(run), f"line long, check long, {OCCURRENCE}")


def segments(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` (from 0) of lines of the given lengths: the
    longer segments come last."""
    size, longer = length // (edits + 1), length % (edits + 1)
    extra = np.maximum(0, i - (edits + 1 - longer))
    return i * size + extra, size + (i >= edits + 1 - longer)


def shifts(i: int, more: int, edits: int) -> range:
    """Shifts of segment ``i`` that a line longer by ``more`` has to be probed at: at
    most i edits stand before it, and at most edits - i after it."""
    low, high = max(-i, more - (edits - i)), min(i, more + (edits - i))
    return range(low, high + 1)


def buckets(docs: DataFrame, edits: int = EDITS, near: int = NEAR) -> DataFrame:
    """(bucket, rep): where each line is filed, rep being its hash.  A task files a line
    again only when it has met ``FILED`` others since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                x = Lines(part.column("text"))
                lines, which = np.unique(x.hash, return_index=True)
                at = np.searchsorted(filed, lines)
                fresh = filed[np.minimum(at, len(filed) - 1)] != lines if len(filed) else np.ones(len(lines), bool)
                lines, which = lines[fresh], which[fresh]
                filed = np.sort(np.concatenate([filed, lines])) if len(filed) < FILED else lines
                point = np.flatnonzero((x.data & 0xC0) != 0x80)  # bytes that begin a character
                begin = np.searchsorted(point, x.begin[which])
                length = np.searchsorted(point, x.end[which]) - begin
                point = np.append(point, len(x.data))
                keys, reps = [], []
                for more in range(edits + 1):
                    some = np.flatnonzero(length - more >= near)
                    for i in range(edits + 1):
                        at, size = segments(length[some] - more, i, edits)
                        for shift in shifts(i, more, edits):
                            a, b = at + shift, at + shift + size
                            ok = np.flatnonzero((a >= 0) & (b <= length[some]))
                            start, end = point[begin[some[ok]] + a[ok]], point[begin[some[ok]] + b[ok]]
                            tag = ((length[some[ok]] - more) * (edits + 1) + i).astype(np.uint64)
                            keys.append(mix(hash_spans(x.sums, start, end) ^ mix(tag + np.uint64(1))))
                            reps.append(lines[some[ok]])
                key, rep = np.concatenate(keys).view(np.int64), np.concatenate(reps).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep)], ["bucket", "rep"])

    return docs.select("text").mapInArrow(tidied(run), "bucket long, rep long")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, content) of the lines in ``wanted`` (rep, ord, k, no)."""
    by_doc = wanted.groupBy("ord", "k").agg(F.collect_list(F.struct("no", "rep")).alias("wanted"))  # a text's lines at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, content = [], []
            for text, items in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                lines = text.split("\n")
                for item in items:
                    reps.append(item["rep"])
                    content.append(lines[item["no"]])
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(content, pa.string())], ["rep", "content"])

    # The texts meet the short lists unsorted, and only those that have one are told from copies.
    held = docs.join(by_doc.hint("shuffle_hash"), ["ord", "k"]).dropDuplicates(["ord", "k"]).select("text", "wanted")
    return held.mapInArrow(tidied(run), "rep long, content string")


def char_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and how often each character (its code modulo ``CELLS``) occurs.  An edit
    changes the counts of two characters at most, so lines whose counts differ by more than
    2 * edits in all are farther apart."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) % CELLS
    table = np.bincount(np.repeat(np.arange(len(texts)), sizes) * CELLS + points, minlength=len(texts) * CELLS)
    return sizes, table.reshape(-1, CELLS).astype(np.int32)


def confirm(pairs: DataFrame, texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """The pairs (a, b) whose lines are at most ``edits`` edits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, PAIRS) for k in range(0, batch.num_rows, PAIRS)):
                left, right = part.column("left").to_pylist(), part.column("right").to_pylist()
                (sizes, table), (others, other) = char_counts(left), char_counts(right)
                keep = (np.abs(sizes - others) <= edits) & (np.abs(table - other).sum(1) <= 2 * edits)
                for i in np.flatnonzero(keep).tolist():
                    keep[i] = within(left[i], right[i], edits)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("rep").alias("a"), F.col("content").alias("left"))
    right = texts.select(F.col("rep").alias("b"), F.col("content").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(tidied(run), "a long, b long")


def _meeting(rows: pa.Table, edits: int) -> pa.RecordBatch:
    """Pairs of different labels within ``edits``; ``char_counts`` tell which are never compared."""
    rep, label = rows["rep"].to_numpy(), rows["label"].to_numpy()
    texts = rows["content"].to_pylist()
    sizes, table = char_counts(texts)
    a, b = [], []
    for i in range(len(texts) - 1):
        maybe = np.flatnonzero((label[i + 1:] != label[i]) & (np.abs(sizes[i + 1:] - sizes[i]) <= edits)) + i + 1
        if len(maybe):
            maybe = maybe[np.abs(table[maybe] - table[i]).sum(1) <= 2 * edits]
            maybe = maybe[[within(texts[i], texts[j], edits) for j in maybe.tolist()]] if len(maybe) else maybe
            a.append(np.minimum(rep[i], rep[maybe]))
            b.append(np.maximum(rep[i], rep[maybe]))
    return pair_batch(a, b)


def without(docs: DataFrame, gone_col: str) -> DataFrame:
    """``docs`` with the lines whose numbers are in ``gone_col`` left out of ``text``,
    ``n_lines`` and ``n_removed`` added, ``gone_col`` dropped."""
    names = [c for c in docs.columns if c != gone_col]
    schema = docs.select(*names).schema.add("n_lines", "long").add("n_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, cut = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column(gone_col).to_pylist()):
                lines = (text or "").split("\n")
                drop_ = set(gone or ())
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in drop_]) if drop_ else text)
                total.append(len(lines))
                cut.append(len(drop_))
            new = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(total, pa.int64()), "n_removed": pa.array(cut, pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [new[c] if c in new else batch.column(c) for c in schema.names], schema.names)

    return docs.mapInArrow(tidied(run), schema)


def deduplicate(docs: DataFrame, edits: int = EDITS, near: int = NEAR) -> DataFrame:
    """``docs`` with duplicate lines removed from ``text``; adds n_lines, n_removed
    and n_near (lines whose class holds different lines).  Columns with these
    names are replaced."""
    others = [c for c in docs.columns if c not in {"text", "n_lines", "n_removed", "n_near"}]
    keys = keyed(docs.select("doc_id", "text"))
    found = stored(occurrences(keys), "line-occurrences")
    lines = stored(found.groupBy("line").agg(
        F.min(F.struct("ord", "k", "no")).alias("first"), F.count("*").alias("n"),
        (F.min("check") != F.max("check")).alias("unsure")), "lines")

    held: list[DataFrame] = []

    def texts_for(pairs: DataFrame) -> DataFrame:
        """Texts of the lines that share a bucket, looked up once: ``connect`` first pairs
        every one of them with its bucket's centre, and none comes later."""
        if not held:
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct().join(lines.where("NOT unsure"), "line") \
                .select(F.col("line").alias("rep"), "first.ord", "first.k", "first.no")
            held.append(stored(line_texts(keys, wanted), "line-texts"))
        return held[0]

    def confirmed(pairs: DataFrame) -> DataFrame:
        return confirm(pairs, texts_for(pairs), edits)

    def compared(rows: DataFrame) -> DataFrame:
        return meetings(rows.join(held[0], "rep"), ["content"], BLOCK, lambda t: _meeting(t, edits))

    labels = connect(buckets(docs, edits, near), confirmed, compared)
    classed = lines.where("NOT unsure").join(labels.withColumnRenamed("node", "line"), "line", "left") \
        .select("line", "n", "first", "label").where("n > 1 OR label IS NOT NULL")
    label = F.coalesce("label", "line")
    firsts = classed.groupBy(label.alias("class")).agg(F.min("first").alias("class_first"))
    classed = stored(classed.withColumn("class", label).join(firsts, "class").select(
        "line", "class_first", F.col("label").isNotNull().alias("near")), "line-classes")
    here = F.struct("ord", "k", "no")
    judged = found.join(classed, "line").groupBy("ord", "k").agg(
        F.collect_set(F.when(here > F.col("class_first"), F.col("no"))).alias("gone"),
        F.count_if("near").alias("n_near"))  # at most a text's lines
    judged = stored(judged, "lines-to-remove")
    for used in (found, lines, labels, classed, *held):
        drop(used)
    # Names that no column of ``docs`` has.
    free = "_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    ord_, k, gone = (free + n for n in ("ord", "k", "gone"))
    d = docs.withColumn(ord_, F.coalesce("doc_id", F.lit(-2**63))).withColumn(k, F.xxhash64("text"))
    j = judged.select(F.col("ord").alias(ord_), F.col("k").alias(k), F.col("gone").alias(gone), F.col("n_near").alias(free + "near"))
    joined = d.join(j.hint("shuffle_hash"), [ord_, k], "left").select(
        *(F.col(f"`{c}`") for c in others), "text", F.coalesce(free + "near", F.lit(0)).alias("n_near"), gone)
    return without(joined, gone)
