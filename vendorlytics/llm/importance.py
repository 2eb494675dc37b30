"""Target-distribution importance resampling.

Texts are seen as bags of hashed runs of one and two words.  A bucket's gain is the
logarithm of its share in the target over its share in the corpus; a document's
weight is the mean gain of its features, looked up in one array of gains.  With
Gumbel noise drawn from each id's hash, the highest scores are a sample without
replacement in proportion to exp(weight); ``regular_sort`` ranks them exactly.

Features are counted and scored in Arrow batches: a two-word feature's checksum
follows from those of its words (CRC-32 is linear), so that no feature text is made.

Defined results: a null or empty text has no features, weight 0 and no rank; a null
id has the noise of an empty id and comes after all other ids of its score; rows that
share an id are drawn one by one; an empty target leaves all gains to the
corpus; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlytics.llm.regular_sort import first_ranks
from vendorlytics.llm.storage import stored
from vendorlytics.llm.text import LOWER, Words, inside, slices, text_bytes, tidied

BUCKETS = 10_000
PERCENT = 25
MIN_WORDS = 20
SEED = 7
# Word bytes: 0-9, a-z (texts are lower-cased first) and all beyond ASCII.
SEPARATORS = np.ones(256, bool)
SEPARATORS[48:58] = SEPARATORS[97:123] = SEPARATORS[128:] = False


# ------------------------------------------------------------------ CRC-32 of joined words

def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


_STEP = _byte_table()
_NEAR = 64  # lengths with a table of their own


def _shift_tables() -> np.ndarray:
    """[length, byte place, byte]: what that byte of a checksum becomes when so many
    bytes follow."""
    out = np.empty((_NEAR + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _NEAR + 1):
        out[n] = _STEP[out[n - 1] & 0xFF] ^ (out[n - 1] >> 8)
    return out


_SHIFT = _shift_tables().reshape(-1)
_ONCE = _NEAR * 1024  # place of the longest table


def _shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums' share in the checksum of a text that goes on for ``lengths`` bytes."""
    left = lengths.copy()
    while len(far := np.flatnonzero(left > _NEAR)):
        if left[far].min() > 1 << 16:  # very long words: zlib's own checksum of as many zero bytes
            out = crcs.copy()
            for i in far.tolist():
                zeros = bytes(int(left[i]))
                out[i] = zlib.crc32(zeros, int(crcs[i])) ^ zlib.crc32(zeros)
            crcs, left[far] = out, 0
            break
        c = crcs[far]
        crcs = crcs.copy()
        crcs[far] = _lookup(c, np.full(len(far), _ONCE))
        left[far] -= _NEAR
    return _lookup(crcs, left * 1024)


def _lookup(c: np.ndarray, base: np.ndarray) -> np.ndarray:
    out = _SHIFT[base + (c & 0xFF)]
    for k in (1, 2, 3):
        out = out ^ _SHIFT[base + 256 * k + ((c >> np.uint32(8 * k)) & 0xFF)]
    return out


class Features:
    """Buckets of the features of some texts: one for each word, one for each two
    neighbouring words of a text, which begin at the places ``pairs``."""

    def __init__(self, column: pa.Array, buckets: int):
        data, offsets = text_bytes(column)
        words = Words(LOWER[data], offsets, SEPARATORS)
        self.first = words.first
        coded = words.array().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy()
        space = zlib.crc32(b" ")
        crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
        after = np.fromiter((zlib.crc32(w, space) for w in distinct), np.uint32, len(distinct))  # of " word"
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1
        self.pairs = inside(self.first, 2)
        left, right = code[self.pairs], code[self.pairs + 1]
        self.words = (crc % np.uint32(buckets)).astype(np.int64)[code]
        self.two = ((_shifted(crc[left], size[right]) ^ after[right]) % np.uint32(buckets)).astype(np.int64)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Sum of the gains of each text's features."""
        each = gains[self.words]
        each[self.pairs] += gains[self.two]
        total = np.append(0, np.cumsum(each))
        return total[self.first[1:]] - total[self.first[:-1]]


# ------------------------------------------------------------------ counts, weights, ranks

def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Features of all texts in each bucket.  Each task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                f = Features(piece.column("text"), buckets)
                total += np.bincount(f.words, minlength=buckets) + np.bincount(f.two, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(tidied(run), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over corpus share, with one
    more feature in every bucket."""
    s, t, n = corpus.sum().item(), target.sum().item(), len(corpus)
    return np.array([math.floor(1000 * math.log((y + 1) * (s + n) / ((x + 1) * (t + n))))
                     for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                f = Features(piece.column("text"), buckets)
                words = f.counts()
                n = words + np.maximum(words - 1, 0)
                weight = np.where(n > 0, f.sums(gains) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"])

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(tidied(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw from the id's hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Per document row: doc_id, n_words, n_features, weight, score, rank (1, 2, 3 ...
    for the drawn ``percent`` of the documents of at least ``min_words`` words, null
    for the others).  ``docs`` has integer ids, ``target`` is a table with ``text``."""
    gains = log_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    weighed = weigh(docs, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)) \
        .withColumn("row", F.monotonically_increasing_id())
    weighed = stored(weighed, "weights")
    long_enough = weighed.where(F.col("n_words") >= min_words).select(
        "*", (-F.col("score")).alias("down"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    n = long_enough.count()
    ranked = first_ranks(long_enough, ["down", "id", "row"], percent * n // 100, n).drop("down", "id")
    short = weighed.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(short).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
