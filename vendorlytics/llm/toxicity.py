"""Toxic spans and document scores by a linear-chain conditional random field.

The field tags tokens as toxic or not.  Labels are given by document, so token
labels are drawn from them: a word form or prefix that marks toxic documents far
beyond chance (likelihood ratio at least ``EVIDENCE``, toxic share at least
``SHARE``) labels its tokens in toxic documents; all others are clean.  Emissions
are hashed weights of the lower-cased form, its prefixes and its last letters, so
that unseen forms of a known stem are recognised.  Forward-backward marginals
give the offending spans, and per document their sum and maximum; a logistic
curve fitted on documents that the field hasn't seen turns these into a score.

The fit uses at most ``SAMPLE`` labelled documents of each class, chosen by hash
of the id; ids whose crc32 modulo 4 is 2 are never learned from.  Scores use the
text alone.

Defined results: a null, empty or wordless text gets the score of no evidence; a
document with several labels is toxic if one is 1; null labels are ignored; of different
texts that share a labelled id, one is learned from;
without labelled documents of both classes every score is next to 0; repeated rows each
get their result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlytics.llm.crf import Chains, observed_transitions
from vendorlytics.llm.storage import drop, stored
from vendorlytics.llm.text import LOWER, Words, doc_of, give_back, hash_spans, mix, slices, span_sums, text_bytes, tidied

SAMPLE = 4000
THRESHOLD, CLEAN = 0.3, 0.05
EVIDENCE, SHARE = 30.0, 0.8
BITS = 20
PREFIXES = (3, 4, 5, 6)
ROUNDS, BATCH, RATE, DECAY = 4, 256, 0.3, 1e-6
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


class Tokens:
    """The distinct word forms of some texts, and each token's form."""

    def __init__(self, column: pa.Array):
        data, self.offsets = text_bytes(column)
        self.words = Words(LOWER[data], self.offsets, _BREAKS)
        self.data, self.first = data, self.words.first
        coded = self.words.array().dictionary_encode()
        self.form = coded.indices.to_numpy()
        forms = coded.dictionary
        at = np.frombuffer(forms.buffers()[1], np.int64)[forms.offset:forms.offset + len(forms) + 1]
        if not len(forms):
            self.features = np.zeros((0, 2 + len(PREFIXES)), np.uint64)
            return
        sums = span_sums(np.frombuffer(forms.buffers()[2], np.uint8)[:at[-1]])
        start, end = at[:-1], at[1:]
        kinds = [hash_spans(sums, start, end)]
        kinds += [hash_spans(sums, start, np.minimum(end, start + k)) for k in PREFIXES]
        kinds += [hash_spans(sums, np.maximum(start, end - 3), end)]
        self.features = np.stack([mix(h + np.uint64(k)) for k, h in enumerate(kinds)], 1)

    def slots(self) -> np.ndarray:
        return (self.features >> np.uint64(64 - BITS)).astype(np.int64)

    def spans(self, marginals: np.ndarray) -> list[list[tuple[int, int]]]:
        """Code-point ranges of runs of tokens with marginals of at least a half."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(self.first) - 1)]
        bad = np.flatnonzero(marginals >= 0.5)
        if len(bad):
            points = np.append(0, np.cumsum((self.data & 0xC0) != 0x80))
            sizes = np.diff(self.words.bounds)
            doc = doc_of(self.first, bad)
            begin = points[self.words.at[bad]] - points[self.offsets[doc]]
            end = points[self.words.at[bad] + sizes[bad]] - points[self.offsets[doc]]
            for t, d, b, e in zip(bad.tolist(), doc.tolist(), begin.tolist(), end.tolist()):
                runs = out[d]
                if runs and last == t - 1:
                    runs[-1] = (runs[-1][0], e)
                else:
                    runs.append((b, e))
                last = t
        return out


class Tagger:
    def __init__(self):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.transition = np.zeros((2, 2))  # logarithms
        self.start = 0.0
        self.curve = np.zeros(3)

    def marginals(self, tokens: Tokens) -> np.ndarray:
        e = self.weights[tokens.slots()].sum(1)[tokens.form] if len(tokens.form) else np.zeros(0)
        return Chains(tokens.first).run(e, np.exp(self.transition), self.start)[0]

    def evidence(self, tokens: Tokens, marginals: np.ndarray) -> np.ndarray:
        """Per document: 1, the log of expected toxic tokens (of those that aren't
        plainly clean) and the log odds of the surest."""
        n = len(tokens.first) - 1
        total, most = np.zeros(n), np.zeros(n)
        some = np.flatnonzero(np.diff(tokens.first))
        if len(some):
            total[some] = np.add.reduceat(np.where(marginals >= CLEAN, marginals, 0), tokens.first[some])
            most[some] = np.maximum.reduceat(marginals, tokens.first[some])
        most = np.clip(most, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(n), np.log1p(total), np.log(most / (1 - most))], 1)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve, -30, 30)))


class Sample:
    """Labelled documents as token forms: token t of document d is one of
    ``form[first[d]:first[d + 1]]``, a row of ``features``."""

    def __init__(self, form: np.ndarray, first: np.ndarray, features: np.ndarray, toxic: np.ndarray, weight: np.ndarray):
        self.form, self.first, self.features, self.toxic, self.weight = form, first, features, toxic, weight

    def part(self, docs: np.ndarray) -> Sample:
        sizes = np.diff(self.first)[docs]
        first = np.append(0, np.cumsum(sizes))
        at = np.repeat(self.first[docs] - first[:-1], sizes) + np.arange(first[-1])
        return Sample(self.form[at], first, self.features, self.toxic[docs], self.weight[docs])

    def slots(self) -> np.ndarray:
        return (self.features >> np.uint64(64 - BITS)).astype(np.int64)


def token_labels(sample: Sample) -> np.ndarray:
    """Which tokens the documents' labels mark as toxic.  Shares and rates count every
    document by its weight, so they estimate those of all labelled documents however
    many were drawn; the evidence counts the documents drawn."""
    toxic, weight, form, features = sample.toxic, sample.weight, sample.form, sample.features
    doc = doc_of(sample.first, np.arange(len(form)))
    pairs = np.unique(doc.astype(np.int64) * len(features) + form)  # forms of each document
    d, form_of = pairs // len(features), pairs % len(features)
    marked = np.zeros(len(features), bool)
    rate = weight[toxic].sum() / weight.sum()
    for k in range(features.shape[1] - 1):  # not by last letters
        names, which = np.unique(features[:, k], return_inverse=True)
        seen = np.unique(d * len(names) + which[form_of])
        name, by = seen % len(names), seen // len(names)
        n = np.bincount(name, minlength=len(names))
        b = np.bincount(name, weights=weight[by], minlength=len(names))
        a = np.bincount(name, weights=weight[by] * toxic[by], minlength=len(names))
        share = a / np.where(b > 0, b, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * n * (np.where(share > 0, share * np.log(share / rate), 0)
                             + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0))
        marked |= ((ratio >= EVIDENCE) & (share >= SHARE))[which]
    return marked[sample.form] & toxic[doc]


def fit(sample: Sample) -> Tagger:
    """Fit the field on the even documents and the curve on the odd ones."""
    tagger, toxic = Tagger(), sample.toxic
    if toxic.all() or not toxic.any():
        tagger.curve[0] = -np.inf
        return tagger
    half = np.arange(len(toxic)) % 2 == 0
    seen, slots = sample.part(np.flatnonzero(half)), sample.slots()
    labels = token_labels(seen).astype(np.int64)
    n = len(seen.toxic)
    squares = np.full(1 << BITS, 1e-6)
    moves, opening = np.full((2, 2), 1e-6), 1e-6
    order = np.random.default_rng(0)
    for _ in range(ROUNDS):
        shuffled = order.permutation(n)
        for at in range(0, n, BATCH):
            docs = np.sort(shuffled[at:at + BATCH])
            sizes = np.diff(seen.first)[docs]
            first = np.append(0, np.cumsum(sizes))
            mine = np.repeat(seen.first[docs] - first[:-1], sizes) + np.arange(first[-1])
            form, y = seen.form[mine], labels[mine]
            e = tagger.weights[slots[form]].sum(1)
            p, expected = Chains(first).run(e, np.exp(tagger.transition), tagger.start)
            scale = 1 / len(docs)
            push = np.bincount(slots[form].ravel(), np.repeat(y - p, slots.shape[1]), 1 << BITS) * scale
            push -= DECAY * tagger.weights
            squares += push**2
            tagger.weights += (RATE * push / np.sqrt(squares)).astype(np.float32)
            turn = (observed_transitions(y, first) - expected) * scale
            turn[0, 0] = 0  # the scale of the matrix is free
            moves += turn**2
            tagger.transition = np.clip(tagger.transition + RATE * turn / np.sqrt(moves), -8, 8)
            some = first[:-1][sizes > 0]
            g = float((y[some] - p[some]).sum()) * scale
            opening += g * g
            tagger.start = float(np.clip(tagger.start + RATE * g / np.sqrt(opening), -8, 8))
    odd = np.flatnonzero(~half)
    x = []
    for at in range(0, len(odd), BATCH):  # in slices: the messages of all at once would be large
        part = sample.part(odd[at:at + BATCH])
        x.append(tagger.evidence(part, tagger.marginals(part)))
    x = np.concatenate(x) if x else np.zeros((0, 3))
    tagger.curve = logistic(x, toxic[odd].astype(float), sample.weight[odd])
    return tagger


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * c
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c))
        step = np.linalg.solve(bend, slope)
        c = c + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return c


def drawn_labels(labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[bool, float]]:
    """(doc_id, toxic) of at most about ``sample`` labelled ids of each class, by hash of the
    id, and the share of each class that is drawn."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")) \
        .where(~held_out(F.col("doc_id"))).withColumn("toxic", (F.col("toxic") == 1)) \
        .withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, 0.9 * sample / n) if n > 0.9 * sample else 1.0 for k, n in sizes.items()}
    drawn = known.where(
        (F.col("toxic") & (F.col("draw") < share.get(True, 1.0))) | (~F.col("toxic") & (F.col("draw") < share.get(False, 1.0))))
    return drawn.select("doc_id", "toxic"), share


def token_forms(docs: DataFrame) -> DataFrame:
    """(doc_id, toxic, forms): each text's token forms as 64-bit hashes.  One row per id:
    of different texts that share an id, the one with the smallest hash counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = Tokens(part.column("text"))
                each = tokens.features[tokens.form, 0] if len(tokens.form) else np.zeros(0, np.uint64)
                held = [each[a:b].tobytes() for a, b in zip(tokens.first[:-1], tokens.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), part.column("text_hash"), pa.array(held, pa.binary())],
                    ["doc_id", "toxic", "text_hash", "forms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(tidied(run), f"doc_id {kind}, toxic boolean, text_hash long, forms binary")
    return rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("forms", "text_hash").alias("forms"))


def form_features(docs: DataFrame) -> DataFrame:
    """(features): the distinct forms of the texts, each as its feature hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                features = Tokens(part.column("text")).features
                yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in features], pa.binary())], ["features"])

    return docs.mapInArrow(tidied(run), "features binary").distinct()


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Fit on at most about ``sample`` labelled documents of each class.  The driver gets
    eight bytes a token and the features of the distinct forms, not the texts."""
    drawn, share = drawn_labels(labels, sample)
    drawn = stored(drawn, "labelled")  # bounded by ``sample``
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
                   .select("doc_id", "toxic", "text", F.xxhash64("text").alias("text_hash")), "labelled-texts")
    features = form_features(texts).toArrow().column("features")
    width = 2 + len(PREFIXES)
    features = np.frombuffer(b"".join(features.to_pylist()), np.uint64).reshape(-1, width)
    features = features[np.argsort(features[:, 0])]
    rows = token_forms(texts).toArrow()
    drop(drawn)
    drop(texts)
    ids, toxic = rows["doc_id"].to_pylist(), np.array(rows["toxic"].to_pylist(), bool)
    order = np.array(sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i])), np.int64)
    held = [np.searchsorted(features[:, 0], np.frombuffer(rows["forms"][int(i)].as_buffer(), np.uint64)).astype(np.int32) for i in order]
    del rows
    first = np.append(0, np.cumsum([len(h) for h in held])).astype(np.int64)
    form = np.concatenate(held) if held else np.zeros(0, np.int32)
    toxic = toxic[order]
    weight = np.where(toxic, 1 / share.get(True, 1.0), 1 / share.get(False, 1.0))
    tagger = fit(Sample(form, first, features, toxic, weight))
    del held, form, first, features
    give_back()  # later stages share this process
    return tagger


def tag(docs: DataFrame, tagger: Tagger, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document row: the columns ``keep``, score, n_toxic (expected toxic tokens)
    and spans (code-point ranges of the offending words)."""
    added = "score double, n_toxic double, spans array<struct<begin: int, end: int>>"
    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string(added).fields])
    read = [*keep] if "text" in keep else [*keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = Tokens(part.column("text"))
                p = tagger.marginals(tokens)
                x = tagger.evidence(tokens, p)
                spans = [[{"begin": b, "end": e} for b, e in runs] for runs in tokens.spans(p)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(tagger.scores(x)), pa.array(np.expm1(x[:, 1])),
                     pa.array(spans, kind)], schema.names)

    return docs.select(*read).mapInArrow(tidied(run), schema)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted, n_toxic, spans."""
    return tag(docs, learn(docs, labels, sample)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic", "spans")
