"""Arrow/numpy text helpers shared by the operators that run in Python tasks.

Everything works on one slice of an Arrow batch at a time (``slices``), so the
memory of a task is set by ``SLICE_BYTES`` and by the longest single text, not
by the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
# Word separators of the library's word rule: space, tab, LF, VT, FF, CR.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``limit`` bytes of ``column``
    (at least one row each)."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column), copy=False)
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(column: pa.Array, copy: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[raw[0]:raw[-1]]
    return (data.copy() if copy else data), raw - raw[0]


def tidied(run):
    """``run`` of a mapInArrow, giving the memory it used back to the system when
    its partition ends: Python workers outlive their tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


class Words:
    """The words of some texts, stored back to back without separators.

    ``data[bounds[i]:bounds[i+1]]`` is word i; text d holds the words
    ``first[d]:first[d+1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        keep = ~separators[data]
        begins = keep.copy()
        begins[1:] &= ~keep[:-1]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[starts] = keep[starts]
        at = self.at = np.flatnonzero(begins)  # places in the texts' own bytes
        self.data = data[keep]
        before = np.cumsum(keep, dtype=np.int64)
        self.bounds = np.append(before[at] - 1, len(self.data))
        self.first = np.searchsorted(at, offsets)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def array(self) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self), [None, pa.py_buffer(self.bounds), pa.py_buffer(self.data)])

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.bounds)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)
_FAR_POW = _powers(np.uint64(pow(int(_BASE), _BLOCK, 1 << 64)), 1 << 14)
_FAR_INV = _powers(np.uint64(pow(int(_INVERSE), _BLOCK, 1 << 64)), 1 << 14)
# One random-looking 64-bit value for each byte value.
_BYTE = np.cumprod(np.full(256, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (xor-shift and multiply, a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span ``data[bounds[i]:bounds[i+1]]``.

    Prefix sums of ``value * base**position`` modulo 2**64, divided by the power
    at the span's start, so that equal spans hash alike wherever they stand.
    """
    return hash_spans(span_sums(data), bounds[:-1], bounds[1:])


def span_sums(data: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    for at in range(0, n, _BLOCK):  # in cache-sized blocks
        piece = _BYTE[data[at:at + _BLOCK]] * _POW[:min(_BLOCK, n - at)]
        piece *= _FAR_POW[at // _BLOCK] if at // _BLOCK < len(_FAR_POW) else np.uint64(pow(int(_BASE), at, 1 << 64))
        sums[at + 1:at + 1 + len(piece)] = piece
    return np.cumsum(sums, out=sums)


def hash_spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``starts[i]:ends[i]`` of the bytes behind ``sums``."""
    back = _INV[starts % _BLOCK]
    far = starts // _BLOCK
    if len(far) and far.max() >= len(_FAR_INV):
        back = back * np.array([pow(int(_INVERSE), int(f) * _BLOCK, 1 << 64) for f in far], np.uint64)
    else:
        back = back * _FAR_INV[far]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (``len - width + 1``
    values); runs are taken over the whole array, callers mask those that cross
    a text's end."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xA0761D6478BD642F + 0x632BE59BD9B4E019 * 2 * seed) % (1 << 64) | 5)
    level = mix(words ^ np.uint64(0x8BB84B93962EACC9 * (seed + 1) % (1 << 64)))
    out, done, size = None, 0, 1
    while True:  # binary doubling: level holds the hashes of runs of ``size`` words
        if width & size:
            if out is None:
                out = level
            else:
                m = len(words) - done - size + 1
                out = out[:m] * np.uint64(pow(int(base), size, 1 << 64)) + level[done:done + m]
            done += size
        size <<= 1
        if size > width:
            return mix(out[:n])
        half = size >> 1
        level = level[:-half] * np.uint64(pow(int(base), half, 1 << 64)) + level[half:]


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` words that lie within one text."""
    n = int(first[-1])
    ok = np.ones(max(0, n - width + 1), bool)
    for k in range(1, width):  # a window that starts within width - 1 words before a text's end crosses it
        at = first[1:-1] - k
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return np.flatnonzero(ok)


def doc_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Text that each word position belongs to."""
    return np.searchsorted(first, at, side="right") - 1


def ragged(lengths: np.ndarray) -> np.ndarray:
    """Offsets (one more than ``lengths``)."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class ChunkCache:
    """Token ids of text chunks, kept until ``clear``: two generations of up to
    ``limit`` chunks, of which the older goes when the younger is full.  Chunks of
    more than ``longest`` bytes are encoded but not kept.

    ``encode(list of bytes) -> list of int32 bytes`` is called for the chunks
    that the cache lacks.
    """

    def __init__(self, encode, limit: int = 100_000, longest: float = float("inf")):
        self.encode, self.limit, self.longest, self.young, self.old = encode, limit, longest, {}, {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def ids(self, chunks: pa.Array) -> pa.ListArray:
        """ids of each chunk, as a large list array."""
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        young, old = self.young, self.old
        found = list(map(young.get, distinct))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                chunk = distinct[i]
                ids = found[i] = old.get(chunk)
                if ids is None:
                    missing.append(i)
                else:
                    young[chunk] = ids
        for i, ids in zip(missing, self.encode([distinct[i] for i in missing]) if missing else ()):
            found[i] = ids
            if len(distinct[i]) <= self.longest:
                young[distinct[i]] = ids
        if len(young) > self.limit:
            self.old, self.young = young, {}
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        lists = pa.LargeListArray.from_arrays(pa.array(ragged(sizes)), pa.array(flat))
        return lists.take(coded.indices)


def chunk_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The chunks of ``data`` that begin at ``starts`` (the first at 0)."""
    bounds = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
