"""Substring deduplication by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document; a word is removed if a
window that covers it occurs earlier too (smaller id, or same document and
earlier start).  The cover {0, 1, 3, 9} modulo 13 has every difference modulo 13,
so two equal windows of 20 words, wherever they start, share an anchor: 8 words
that begin at a cover position in both.  Only anchors are hashed and dealt by
hash over the whole corpus (4 of 13 positions); the windows around repeated
anchors are the candidates, and comparing their own 128-bit hashes extends the
matches to full windows.

Skew: a slice of texts sends one row for each distinct anchor or window; the
other occurrences in the slice are known to repeat and are dealt by document.
Rows of one hash arrive sorted and are compared with their neighbour only, so no
group is ever held.  Later copies of a whole text are recognised by its digest.

Defined results: null and empty texts have no words; a null id comes before all
others; rows that share id and text are one document and each gets its result;
of different texts that share an id, the one with the smaller hash is the
earlier; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics.llm.storage import drop, stored
from vendorlytics.llm.text import Words, doc_of, inside, mix, slices, text_bytes, tidied, window_hashes

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
SINGLE, FIRST, KNOWN = 0, 1, 2
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
KEY = "ord long, k long"


def keyed(docs: DataFrame) -> DataFrame:
    """Each row's order (``ord``, ``k``): the id, then the text's hash."""
    return docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(-2**63)).alias("ord"), F.xxhash64("text").alias("k"), "text")


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Words]:
    data, offsets = text_bytes(part.column("text"))
    words = Words(data, offsets)
    return part.column("ord").to_numpy(), part.column("k").to_numpy(), words


def spread(ord_: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A hash of the row's key: copies of one text part by their ids."""
    return mix(k.view(np.uint64) + mix(ord_.view(np.uint64)))


def _numbers(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def anchors(docs: DataFrame) -> DataFrame:
    """(deal, kind, ord, k, pos) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ord_, k, words = _words(part)
                at = inside(words.first, ANCHOR)
                doc = doc_of(words.first, at)
                pos = at - words.first[doc]
                cover = _IN_COVER[pos % PERIOD]
                at, doc, pos = at[cover], doc[cover], pos[cover]
                h = window_hashes(words.hashes(), ANCHOR)[at]
                order = np.argsort(h, kind="stable")
                s = h[order]
                new = np.append(True, s[1:] != s[:-1])[:len(s)]
                alone = new & np.append(new[1:], True)[:len(s)]
                kind = np.where(alone, SINGLE, np.where(new, FIRST, KNOWN)).astype(np.int8)
                doc, pos = doc[order], pos[order]
                deal = np.where(kind == KNOWN, spread(ord_[doc], k[doc]), s).view(np.int64)
                yield _numbers(deal=deal, kind=kind, ord=ord_[doc], k=k[doc], pos=pos.astype(np.int32))

    return docs.select("ord", "k", "text").mapInArrow(tidied(run), f"deal long, kind byte, {KEY}, pos int")


def repeated(anchored: DataFrame) -> DataFrame:
    """(ord, k, pos) of the anchors whose hash occurs at another place too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, None  # the last hash, and its row if nothing yet says that it repeats
        for batch in batches:
            known = batch.column("kind").to_numpy() == KNOWN
            rows = batch.select(["ord", "k", "pos"])
            if known.any():
                yield rows.filter(pa.array(known))
                batch, rows = batch.filter(pa.array(~known)), rows.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            h, first = batch.column("deal").to_numpy(), batch.column("kind").to_numpy() == FIRST
            same = np.append(last is not None and h[0] == last, h[1:] == h[:-1])
            if waiting is not None and same[0]:
                yield waiting
            flag = same | first
            flag[:-1] |= same[1:]
            last, waiting = h[-1], None if flag[-1] else rows.slice(len(h) - 1, 1)
            yield rows.filter(pa.array(flag))

    return anchored.repartition("deal").sortWithinPartitions("deal").mapInArrow(tidied(run), f"{KEY}, pos int")


def candidate_windows(docs: DataFrame) -> DataFrame:
    """(deal, w2, known, ord, k, start): the windows that hold a repeated anchor,
    from documents with the anchors' places (``places``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ord_, k, words = _words(part)
                places = part.column("places")
                doc = np.repeat(np.arange(len(part)), pa.compute.list_value_length(places).to_numpy(zero_copy_only=False))
                at = words.first[doc] + places.flatten().to_numpy()
                edge = np.zeros(len(words) + 1, np.int64)
                low = np.maximum(at - (PERIOD - 1), words.first[doc])
                np.add.at(edge, low, 1)
                np.add.at(edge, at + 1, -1)
                near = np.cumsum(edge)[:-1] > 0
                start = inside(words.first, WINDOW)
                start = start[near[start]]
                hashes = words.hashes()
                one = window_hashes(hashes, WINDOW)[start].view(np.int64)
                two = window_hashes(hashes, WINDOW, seed=1)[start].view(np.int64)
                doc = doc_of(words.first, start)
                place = (start - words.first[doc]).astype(np.int32)
                o, q = ord_[doc], k[doc]
                order = np.lexsort((place, q, o, two, one))
                one, two, o, q, place = one[order], two[order], o[order], q[order], place[order]
                known = np.zeros(len(one), bool)
                known[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                deal = np.where(known, spread(o, q).view(np.int64), one)
                yield _numbers(deal=deal, w2=two, known=known, ord=o, k=q, start=place)

    return docs.mapInArrow(tidied(run), f"deal long, w2 long, known boolean, {KEY}, start int")


def later(found: DataFrame) -> DataFrame:
    """(ord, k, start) of the windows that occur earlier too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            one, two = batch.column("deal").to_numpy(), batch.column("w2").to_numpy()
            flag = known.copy()
            mine = np.flatnonzero(~known)
            if len(mine):
                a, b = one[mine], two[mine]
                same = np.append(last == (a[0], b[0]), (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
                flag[mine] = same
                last = (a[-1], b[-1])
            yield batch.select(["ord", "k", "start"]).filter(pa.array(flag))

    return found.repartition("deal").sortWithinPartitions("deal", "w2", "ord", "k", "start") \
        .mapInArrow(tidied(run), f"{KEY}, start int")


def removed(docs: DataFrame) -> DataFrame:
    """Beside ``doc_id``: n_words, n_removed and the kept words joined by a space
    (``kept_text``), from documents with ``starts`` (of windows to remove) and
    ``copy`` (a later copy of a whole text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                words = Words(data, offsets)
                counts = words.counts()
                starts = part.column("starts").fill_null([])
                doc = np.repeat(np.arange(len(part)), pa.compute.list_value_length(starts).to_numpy(zero_copy_only=False))
                at = words.first[doc] + starts.flatten().to_numpy()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                copies = part.column("copy").fill_null(False).to_numpy(zero_copy_only=False) & (counts >= WINDOW)
                gone |= np.repeat(copies, counts)
                sizes = np.diff(words.bounds) + 1
                spaced = np.insert(words.data, words.bounds[1:], 32)[np.repeat(~gone, sizes)].tobytes()
                ends = np.append(0, np.cumsum(np.where(gone, 0, sizes)))[words.first]
                kept = [spaced[a:max(a, b - 1)].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                cut = np.append(0, np.cumsum(gone))[words.first]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(np.diff(cut).astype(np.int64)),
                     pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, kept_text string")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept_text."""
    docs = keyed(docs.select("doc_id", "text"))
    digests = docs.select("ord", "k", F.md5(F.coalesce("text", F.lit(""))).alias("digest")).distinct()
    firsts = digests.groupBy("digest").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = stored(digests.join(firsts, "digest").where("ord > first").select("ord", "k"), "copies")

    places = repeated(anchors(docs)).join(copies, ["ord", "k"], "left_anti") \
        .groupBy("ord", "k").agg(F.sort_array(F.collect_set("pos")).alias("places"))  # at most a text's words
    places = stored(places, "anchor-places")
    held = docs.dropDuplicates(["ord", "k"]).join(places, ["ord", "k"]).select("ord", "k", "text", "places")
    starts = stored(later(candidate_windows(held)).groupBy("ord", "k").agg(
        F.sort_array(F.collect_set("start")).alias("starts")), "window-starts")
    out = docs.join(starts, ["ord", "k"], "left").join(copies.withColumn("copy", F.lit(True)), ["ord", "k"], "left")
    drop(places)
    return removed(out.select("doc_id", "text", "starts", "copy"))
