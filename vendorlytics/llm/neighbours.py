"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected on ``DIMS`` fixed Gaussian directions.  For a point at distance
d, its squared projected distance over d^2 follows a chi-square law with ``DIMS``
degrees, so projected neighbours are taken in ascending order and verified on the
original vectors until the next one lies so far that a point as near as the worst
answer would be there with a probability under 1 - ``CONFIDENCE`` only.

The index is a kd-tree in the projected space: its top, split at medians of a bounded
sample, deals every row into cells; a cell's own tree is built where the cell is
searched.  A query meets its nearest cells first and, with the distance that they
leave, those that the stopping test doesn't rule out (the rest of the rows by blocks, not
a cross join).  A cell's tree is visited likewise, from the nearest leaf outwards.

Equal vectors are one point with its smallest ids (as many as an answer can show), and
queries with equal vectors are searched once, so a vector that a third of the rows
share is no hot cell.

Defined results: vectors that are null, empty, zero, hold null or non-finite
components, or have another length than the commonest (the shorter of equally common
ones) take no part, nor do rows without id; rows equal in id and vector count once; if
different vectors share an id, each is a candidate for the other, and each is answered
when its id asks; other columns are ignored; fewer candidates give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlytics.llm.storage import drop, stored
from vendorlytics.llm.text import tidied

K = 10
DIMS = 8
CONFIDENCE = 0.98
SEED = 12
SAMPLE = 20_000      # vectors that the top of the tree is split by
CELL = 8_192         # rows a cell aims at
CELLS = (8, 2_048)   # fewest and most cells
LEAF = 256
NEAREST = 2          # cells that a query meets before the rest
BATCH = 256          # queries that go through a cell together
KEY = ["h1", "h2"]   # a vector's hash, 128 bits


def chi_square_quantile(dims: int, p: float) -> float:
    """x with P(chi-square of an even number of degrees <= x) = p, by bisection."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(length: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dims))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of a list column as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


# ------------------------------------------------------------------ kd-trees

def split_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) of the inner nodes 1 ... 2^depth - 1 of a tree that splits
    ``points`` at medians of the widest axis."""
    axis, cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    held = {1: points}
    for node in range(1, 1 << depth):
        at = held.pop(node)
        if len(at):
            axis[node] = k = int(np.argmax(at.max(0) - at.min(0)))
            cut[node] = np.median(at[:, k])
        right = at[:, axis[node]] > cut[node]
        held[2 * node], held[2 * node + 1] = at[~right], at[right]
    return axis, cut


def cell_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    axis, cut = tree
    node = np.ones(len(points), np.int64)
    rows = np.arange(len(points))
    while len(axis) > 1 and len(points) and node[0] < len(axis):
        node = 2 * node + (points[rows, axis[node]] > cut[node])
    return node - len(axis) if len(axis) > 1 else np.zeros(len(points), np.int64)


def box_distances(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    out = np.zeros((len(queries), len(lo)))
    for k in range(queries.shape[1]):
        q = queries[:, k, None]
        gap = np.maximum(np.maximum(lo[None, :, k] - q, q - hi[None, :, k]), 0)
        out += gap * gap
    return out


class Cell:
    """The rows of one cell and the kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: np.ndarray, stop: float):
        self.projection, self.stop = projection, stop
        points = vectors @ projection
        depth = max(0, math.ceil(math.log2(max(1, len(ids)) / LEAF)))
        leaf = cell_of(points, split_tree(points, depth))
        order = np.argsort(leaf, kind="stable")
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.starts = np.flatnonzero(np.append(True, np.diff(leaf[order]) > 0)) if len(ids) else np.zeros(0, np.int64)
        self.ends = np.append(self.starts[1:], len(ids))
        self.lo = np.minimum.reduceat(self.points, self.starts)
        self.hi = np.maximum.reduceat(self.points, self.starts)

    def search(self, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, squared distance) of up to k answers each, none beyond
        ``bounds`` (squared)."""
        seen = queries @ self.projection
        gap = box_distances(seen, self.lo, self.hi)
        turn = np.argsort(np.argsort(gap, axis=1), axis=1)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        worst = bounds.copy()
        for first, last in ((0, 1), (1, 8), (8, len(self.lo))):  # waves of leaves, from the nearest on
            for leaf in range(len(self.lo)):
                due = np.flatnonzero((turn[:, leaf] >= first) & (turn[:, leaf] < last) & (gap[:, leaf] <= self.stop * worst))
                if len(due):
                    best = self._verify(queries, seen, due, leaf, worst, best)
            best = self._keep(best, worst, k)
        return best

    def _verify(self, queries, seen, due, leaf, worst, best):
        a, b = self.starts[leaf], self.ends[leaf]
        apart = ((seen[due][:, None] - self.points[None, a:b]) ** 2).sum(-1)
        i, j = np.nonzero(apart <= self.stop * worst[due][:, None])
        i, j = due[i], j + a
        step = queries[i] - self.vectors[j]
        d = (step * step).sum(1)
        near = d <= worst[i]
        return tuple(np.concatenate([x, y[near]]) for x, y in zip(best, (i, self.ids[j], d)))

    @staticmethod
    def _keep(best, worst, k):
        """The k first of each query by distance and id; ``worst`` follows."""
        q, ids, d = best
        order = np.lexsort([ids, d, q])
        q, ids, d = q[order], ids[order], d[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = place == k - 1
        worst[q[last]] = np.minimum(worst[q[last]], d[last])
        top = place < k
        return q[top], ids[top], d[top]


# ------------------------------------------------------------------ rows

def points_of(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """(id, vector, h1, h2) of the rows that take part, and the vectors' length."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    read = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where(
        F.col("id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    lengths = read.groupBy(F.size(v).alias("length")).count().orderBy(F.desc("count"), "length").first()
    length = lengths.length if lengths else 1
    # Two hashes of the vector and of the vector with a mark.
    return read.where(F.size(v) == length).withColumns({
        "h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")}), length


def project(rows: DataFrame, projection: np.ndarray, tree, extra: list[str], length: int) -> DataFrame:
    """``extra`` columns and the vector, with the cell that it falls in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = cell_of(matrix(b.column("vector"), length) @ projection, tree).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    read = rows.select(*extra, "vector")
    return read.mapInArrow(tidied(run), read.select("*", F.lit(0).alias("cell")).schema)


def boxes(index: DataFrame, projection: np.ndarray, cells: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of the projections in each cell (empty cells: infinitely far)."""
    dims = projection.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full((cells, dims), np.inf), np.full((cells, dims), -np.inf)
        for b in batches:
            at, x = b.column("cell").to_numpy(), matrix(b.column("vector"), length) @ projection
            np.minimum.at(lo, at, x)
            np.maximum.at(hi, at, x)
        c, d = np.nonzero(np.isfinite(lo))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(lo[c, d]), pa.array(hi[c, d])], ["c", "d", "lo", "hi"])

    found = index.select("cell", "vector").mapInArrow(tidied(run), "c long, d long, lo double, hi double") \
        .groupBy("c", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    lo, hi = np.full((cells, dims), np.inf), np.full((cells, dims), np.inf)
    for r in found:
        lo[r.c, r.d], hi[r.c, r.d] = r.lo, r.hi
    return lo, hi


def visits(asked: DataFrame, projection: np.ndarray, lo: np.ndarray, hi: np.ndarray, turns: tuple[int, int],
           stop: float, length: int) -> DataFrame:
    """(cell, h1, h2, bound, vector): the cells that each query meets, those with
    the turns ``turns`` by projected distance that pass the stopping test."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                gap = box_distances(matrix(b.column("vector"), length) @ projection, lo, hi)
                turn = np.argsort(np.argsort(gap, axis=1), axis=1)
                bound = b.column("bound").to_numpy()
                i, c = np.nonzero((turn >= turns[0]) & (turn < turns[1]) & np.isfinite(gap) & (gap <= stop * bound[:, None]))
                t = b.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), *(t.column(n) for n in (*KEY, "bound", "vector"))],
                                                 ["cell", *KEY, "bound", "vector"])

    read = asked.select(*KEY, "bound", "vector")
    return read.mapInArrow(tidied(run), read.select(F.lit(0).alias("cell"), "*").schema)


def search_cells(index: DataFrame, due: DataFrame, projection: np.ndarray, stop: float, k: int, length: int) -> DataFrame:
    """(h1, h2, id, d): up to k answers of every query in every cell that it meets.
    A task holds one cell's rows; its queries stream past."""
    rows = index.select("cell", F.lit(0).alias("asks"), "id", *[F.lit(0).cast("long").alias(c) for c in KEY],
                        F.lit(0.0).alias("bound"), "vector").unionByName(
        due.select("cell", F.lit(1).alias("asks"), F.lit(0).cast("long").alias("id"), *KEY, "bound", "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = asks = None
        held: list[pa.RecordBatch] = []
        tree = None
        for batch in batches:
            key = batch.column("cell").to_numpy().astype(np.int64) * 2 + batch.column("asks").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                now, part = int(key[i]) // 2, batch.slice(i, j - i)
                if now != cell:
                    cell, held, tree = now, [], None
                asks = int(key[i]) % 2
                if not asks:
                    held.append(part)
                    continue
                if not held:
                    continue
                if tree is None:
                    t = pa.Table.from_batches(held)
                    tree = Cell(t.column("id").to_numpy(), matrix(t.column("vector"), length), projection, stop)
                for at in range(0, part.num_rows, BATCH):
                    b = part.slice(at, BATCH)
                    q, ids, d = tree.search(matrix(b.column("vector"), length), b.column("bound").to_numpy().copy(), k)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("h1").take(pa.array(q)), b.column("h2").take(pa.array(q)), pa.array(ids), pa.array(d)], [*KEY, "id", "d"])

    return rows.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(
        tidied(run), "h1 long, h2 long, id long, d double")


def nearest(rows: DataFrame, k: int = K, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding",
            dims: int = DIMS, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is
    divisible by ``every``, nearest first, ties to smaller ids; score is the Euclidean
    distance of the original vectors."""
    points, length = points_of(rows, vec_id, vector)
    points = stored(points.dropDuplicates(["id", *KEY]), "points")
    # A vector's k + 2 smallest ids: whichever query asks, k others are among them.
    of_vector = F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))
    slim = stored(points.withColumn("turn", of_vector).where(F.col("turn") <= k + 2).select("id", "vector", *KEY), "distinct-points")
    asking = points.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    asked = stored(asking.groupBy(*KEY).agg(F.first("vector").alias("vector")), "queries")

    n = slim.count()
    projection, stop, found = directions(length, dims), chi_square_quantile(dims, confidence), k + 1
    cells = min(CELLS[1], max(CELLS[0], 1 << max(0, math.ceil(math.log2(max(1, n) / CELL)))))
    sample = slim.orderBy(*KEY).limit(SAMPLE).select("vector").toArrow()
    tree = split_tree(matrix(sample.column("vector"), length) @ projection, int(math.log2(cells)))
    index = stored(project(slim, projection, tree, ["id"], length), "cells")
    lo, hi = boxes(index, projection, cells, length)

    first_bound = asked.withColumn("bound", F.lit(float("inf")).cast("double"))
    near = stored(search_cells(index, visits(first_bound, projection, lo, hi, (0, NEAREST), stop, length),
                               projection, stop, found, length), "near-cells")
    order = Window.partitionBy(*KEY).orderBy("d", "id")
    top = near.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= found)
    bounds = top.groupBy(*KEY).agg(F.max(F.when(F.col("turn") == found, F.col("d"))).alias("worst"))
    left = asked.join(bounds, KEY, "left").withColumn("bound", F.coalesce("worst", F.lit(float("inf")).cast("double")))
    far = search_cells(index, visits(left, projection, lo, hi, (NEAREST, cells), stop, length), projection, stop, found, length)
    best = near.unionByName(far).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= found) \
        .groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("best"))
    # Each asking row takes its vector's answers without itself: at most k + 1 entries a row.
    answers = asking.select(F.col("id").alias("query_id"), *KEY).join(best, KEY).select(
        "query_id", *KEY, F.slice(F.filter("best", lambda x: (x["id"] != F.col("query_id")) | (x["d"] > 0)), 1, k).alias("best"))
    out = answers.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.sqrt("x.d").alias("score"))
    out = stored(out, "neighbours")
    for used in (points, slim, asked, index, near):
        drop(used)
    return out
