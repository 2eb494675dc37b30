"""Connected components of an edge table, by label rounds in DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlytics.llm.storage import drop, releasing_shuffles, stored
from vendorlytics.llm.text import tidied


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node it can
    reach.  A stored table.

    Alternates the large-star step (a node hooks its larger neighbours to its
    smallest one) with the small-star step (it hooks its smaller neighbours and
    itself to it), until the edges are stars.  Both steps group by node with
    partial sums only, and join back by node; edges never pass through the driver.
    """
    both = edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    star = stored(both, "edges")
    while not _are_stars(star):
        star = _step(star, "large")
        star = _step(star, "small")
    roots = star.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    out = stored(star.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(roots), "labels")
    drop(star)
    return out


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (from ``components``) once ``links`` (a, b) tie more nodes together.  The
    old labels are stars already and stand for the links that made them; they are
    dropped where new ones take their place."""
    if links.isEmpty():
        return labels
    known = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
    out = components(known.unionByName(links.select("a", "b")))
    drop(labels)
    return out


def _ends(star: DataFrame, v: tuple, u: tuple, names: tuple[str, str]) -> DataFrame:
    """Two rows an edge, one for each end."""
    both = F.array(*(F.struct(*(c.alias(n) for c, n in zip(end, names))) for end in (v, u)))
    return star.select(F.explode(both).alias("end")).select("end.*")


def _are_stars(star: DataFrame) -> bool:
    """Whether each node of the distinct edges v > u hangs on one node at most and, if
    so, has none hanging on it: then every u is its component's smallest node."""
    ends = _ends(star, (F.col("v"), F.lit(1)), (F.col("u"), F.lit(0)), ("node", "hangs"))
    with releasing_shuffles(star.sparkSession):
        return ends.groupBy("node").agg(F.sum("hangs").alias("on"), F.min("hangs").alias("least")) \
            .where("on > 1 OR on = 1 AND least = 0").isEmpty()


def _step(star: DataFrame, kind: str) -> DataFrame:
    """One star step on edges v > u; those of the large step may repeat."""
    if kind == "large":  # every node m; its larger neighbours v hook to its smallest neighbour or itself
        near = _ends(star, (F.col("v"), F.col("u")), (F.col("u"), F.col("v")), ("m", "n"))
        least = near.groupBy("m").agg(F.least(F.col("m"), F.min("n")).alias("root"))
        out = star.join(least.withColumnRenamed("m", "u"), "u").select("v", F.col("root").alias("u"))
    else:  # every node v; its smaller neighbours and itself hook to the smallest of them
        least = star.groupBy("v").agg(F.min("u").alias("root"))
        # The edge to the smallest hooks the node itself, every other one its lower end.
        out = star.join(least, "v").select(
            F.when(F.col("u") == F.col("root"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("root").alias("u")).distinct()
    after = stored(out, "edges")
    drop(star)
    return after


def meetings(rows: DataFrame, payload: list[str], block: int, meet: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """Distinct pairs (a, b) that ``meet`` finds among rows (bucket, rep, label,
    size, payload ...), size being the bucket's.

    A bucket is dealt into blocks of about ``block`` rows; every two blocks, and
    each block with itself, meet once, as a table that ``meet`` compares.  So a
    bucket of n rows is sent n / block times and never held whole.
    """
    sides = F.ceil(F.col("size") / block).cast("int")
    rows = rows.withColumn("sides", sides).withColumn("mine", F.pmod(F.xxhash64("rep"), sides).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select(
        "bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "rep", "label", *payload)
    fields = ["bucket", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in fields], 1)
            cuts = np.append(0, np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if i == j:
                    continue
                if held and last != tuple(keys[i]):
                    yield meet(pa.Table.from_batches(held))
                    held = []
                last = tuple(keys[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield meet(pa.Table.from_batches(held))

    return met.repartition(*fields).sortWithinPartitions(*fields).mapInArrow(tidied(run), "a long, b long").distinct()


def pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [none])) for x in (a, b)], ["a", "b"])


def connect(buckets: DataFrame, confirm: Callable[[DataFrame], DataFrame],
            compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, label) of all nodes that are linked with another one, from
    ``buckets`` (bucket, rep), rows possibly repeated.

    Every bucket is a star around its smallest rep, and ``confirm`` turns pairs (a,
    b) into true links.  Buckets whose reps the links leave apart go, as rows
    (bucket, rep, label, size), to ``compare``, which returns the pairs of
    different labels that may be linked (see ``meetings``).
    """
    # Dealt by bucket once: each bucket's rows learn its least and last rep, buckets of one
    # rep go (nearly all), then repeated rows, and what is left is counted.
    of = Window.partitionBy("bucket")
    held = buckets.repartition("bucket").select(
        "bucket", "rep", F.min("rep").over(of).alias("centre"), F.max("rep").over(of).alias("last"))
    shared = held.where("centre != last").drop("last").distinct()
    shared = stored(shared.withColumn("size", F.count("*").over(of)), "buckets")
    pairs = stored(shared.where("rep != centre").select(
        F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = stored(confirm(pairs), "links")
    labels = components(links)
    named = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left") \
        .withColumn("label", F.coalesce("label", "rep"))
    apart = named.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l != m").select("bucket")
    named = stored(named.join(apart, "bucket", "left_semi").select("bucket", "rep", "label", "size"), "apart")
    more = stored(compare(named).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    rest = stored(confirm(more), "more-links")
    out = joined(labels, rest)
    for used in (shared, pairs, links, named, more, rest):
        drop(used)
    return out
