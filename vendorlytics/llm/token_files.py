"""Token-id files: texts to ids of a tokenizers vocabulary, entropy-coded.

``write`` orders the documents by id, encodes the whole texts, counts every id
of the corpus, and writes one file a partition with blocks coded by one shared
frequency table (``rans``).  ``read`` decodes the files in parallel and checks
every block's checksum.

A file: the magic, blocks back to back, a footer (Arrow tables ``blocks``,
``marks`` and ``docs``) and its length.  Blocks hold the ids of consecutive
documents without regard to where documents end.  The table of the whole set is
the file ``table``; the order of files and the ids before each are in
``manifest``.

Encoding cuts texts where the byte-level rule always separates tokens: in front
of a space that follows other text, around a single line feed between two
printable characters, and between letters and marks.  Distinct chunks are encoded by the
tokenizers library; a Python worker keeps the ids of up to 2 x 300,000 chunks of at most 64 bytes
from task to task.

Defined results: a null or empty text has the end id alone; documents with
equal ids are ordered by text and each keeps its row; a null id sorts first; an
empty table gives no files and no rows; other columns don't enter the files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.llm import rans
from vendorlytics.llm.storage import drop, open_file, releasing_shuffles, stored, write_file
from vendorlytics.llm.text import ChunkCache, chunk_array, ragged, slices, text_bytes, tidied

MAGIC = b"RANSTOK1"
BLOCKS_AT_ONCE = 48
LINES = 4096
SLICE = 6 << 20
KEPT, LONGEST = 300_000, 64  # chunks of a generation, bytes of a kept chunk
END_ID = 0
_CHARS = np.arange(256)
_LETTER = ((_CHARS >= 65) & (_CHARS <= 90)) | ((_CHARS >= 97) & (_CHARS <= 122))
_MARK = (_CHARS > 32) & (_CHARS < 127) & ~_LETTER & ~((_CHARS >= 48) & (_CHARS <= 57))


class Coder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = np.zeros(self.size, np.int64)  # a byte-level token has one character a byte
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = len(token)
        self.cache = ChunkCache(self.encode_chunks, limit=KEPT, longest=LONGEST)

    def is_line(self, chunk: bytes) -> bool:
        t = chunk.decode()
        return not t[-1].isspace() and not (t[0].isspace() and (t[0] != " " or t[1].isspace())) \
            and not any(x in t for x in self.special)

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Most chunks go through the library as lines of one text, whose ids are
        told apart by their bytes.  A line feed is a token of its own between a
        chunk that doesn't end in white space and one that begins with something
        else, or with a single space before it."""
        out: list[bytes] = [b""] * len(chunks)
        whole, sizes = b"".join(chunks), np.fromiter(map(len, chunks), np.int64, len(chunks))
        good = plain_lines(np.frombuffer(whole, np.uint8), sizes)
        if any(x.encode() in whole for x in self.special):
            good[:] = False
        for i in np.flatnonzero(~good).tolist():
            good[i] = self.is_line(chunks[i])
        lines, alone = np.flatnonzero(good), np.flatnonzero(~good).tolist()
        for i, coded in zip(alone, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in alone], add_special_tokens=False)):
            out[i] = np.array(coded.ids, np.int32).tobytes()
        for k in range(0, len(lines), LINES):
            some = lines[k:k + LINES]
            text = b"\n".join([chunks[i] for i in some.tolist()]).decode()
            coded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(coded[0].ids, np.int32)
            raw, ends = ids.tobytes(), np.cumsum(self.bytes[ids])
            stops = np.cumsum(sizes[some] + 1) - 1
            upto = np.searchsorted(ends, stops) + 1
            if (ends[upto - 1] != stops).any():
                raise ValueError("a token crosses a line")
            first = 0
            for i, at in zip(some.tolist(), (upto * 4).tolist()):
                out[i] = raw[first:at]
                first = at + 4
        return out

    def encode(self, column: pa.Array) -> pa.LargeListArray:
        data, offsets = text_bytes(column)
        starts = safe_cuts(data, offsets, [s.encode() for s in self.special])
        lists = self.cache.ids(chunk_array(data, starts))
        ends = ragged(np.diff(lists.offsets.to_numpy()))
        return pa.LargeListArray.from_arrays(pa.array(ends[np.searchsorted(starts, offsets)]), lists.flatten())


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _solid(first: np.ndarray) -> np.ndarray:
    """Whether a character's first byte is never one of white space."""
    return (first > 32) & (first != 127) & (first != 0xC2) & ((first < 0xE1) | (first > 0xE3))


def plain_lines(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Chunks (none empty, back to back in ``data``) whose first and last bytes show that
    they neither end in white space nor begin with more of it than one space."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    last, previous = data[ends - 1], data[np.maximum(ends - 2, starts)]
    opens = _solid(data[starts]) | ((data[starts] == 32) & (sizes > 1) & _solid(data[np.minimum(starts + 1, ends - 1)]))
    closes = ((last > 32) & (last < 127)) | ((last >= 0x80) & (previous > 0xC2) & (previous < 0xE0))
    return opens & closes


def safe_cuts(data: np.ndarray, offsets: np.ndarray, special: list[bytes] = ()) -> np.ndarray:
    """Chunk starts: the texts' starts, and places where the byte-level rule of
    words, numbers, symbols and white space always begins a new token.

    A space before something else than white space opens a token with what
    follows, whatever stands before it.  A single line feed between printable
    ASCII is a token.  ASCII letters and ASCII marks never share one, except in
    contractions after an apostrophe and in special tokens: where ``special``
    occurs, letters and marks stay together.  Bytes that may begin or end a wide white-space character
    never take part.
    """
    n, raw = len(data), data.tobytes() if special else b""
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins[n] = False
    if n > 2:
        after = np.append(data[1:], np.uint8(32))
        solid = _solid(after)
        last = np.zeros(n, bool)
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        space = (data == 32) & solid & ~last
        begins[:-1] |= space
        before = np.append(np.uint8(32), data[:-1])
        opening = np.zeros(n + 1, bool)
        opening[offsets[:-1]] = True
        line = (data == 10) & solid & ~last & (before > 32) & (before < 127) & ~opening[:-1]
        begins[:-1] |= line
        begins[1:] |= line
        if not any(s in raw for s in special):
            begins[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
            begins[1:-1] |= _MARK[data[:-1]] & _LETTER[data[1:]] & (data[:-1] != 39)
    return np.flatnonzero(begins[:-1])


def encode(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", tally: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian 32-bit numbers, the end id last.  With
    ``tally`` also what ``id_counts`` sums: on the last row of each slice of texts, the slice's
    ids and how often each occurs (32-bit numbers, at most two a token), else null."""
    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_tokens long, ids binary" + ", tally binary" * tally

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                lists = c.encode(part.column(text))
                at = lists.offsets.to_numpy()
                flat = np.insert(lists.flatten().to_numpy(), at[1:], END_ID).astype("<u4")
                at = at + np.arange(len(at))
                ids = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(part), [None, pa.py_buffer(at * 4), pa.py_buffer(flat)])
                columns = [part.column(doc_id), pa.array(np.diff(at)), ids.cast(pa.binary())]
                if tally:
                    found = np.bincount(flat)
                    some = np.flatnonzero(found)
                    last = np.stack([some, found[some]]).astype("<u4").tobytes()
                    columns.append(pa.array([None] * (len(part) - 1) + [last], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "tally"][:len(columns)])

    return df.select(doc_id, text).mapInArrow(tidied(run), schema)


def id_counts(coded: DataFrame) -> dict[int, int]:
    """How often each id occurs (at most the vocabulary's size of rows), from the tallies of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                ids, n = np.frombuffer(raw.as_buffer(), "<u4").reshape(2, -1)
                if len(ids) and ids[-1] >= len(total):  # ascending
                    total = np.append(total, np.zeros(int(ids[-1]) + 1 - len(total), np.int64))
                total[ids] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    counts = coded.where("tally IS NOT NULL").select("tally").mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in counts.collect()}


def _table_bytes(freq: np.ndarray) -> bytes:
    raw = zlib.compress(freq.astype("<u4").tobytes())
    return MAGIC + struct.pack("<II", len(freq), zlib.crc32(raw)) + raw


def _read_table(path: str) -> rans.Table:
    with open_file(path) as f:
        raw = f.read()
    size, check = struct.unpack("<II", raw[8:16])
    if raw[:8] != MAGIC or zlib.crc32(raw[16:]) != check:
        raise ValueError(f"{path}: damaged table")
    return rans.Table(np.frombuffer(zlib.decompress(raw[16:]), "<u4", size))


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class _File:
    """The bytes of one file, in pieces, from batches of (doc_id, n_tokens, ids)."""

    def __init__(self, table: rans.Table):
        self.table, self.at, self.tokens = table, len(MAGIC), 0
        self.blocks: list[tuple] = []
        self.marks: list[np.ndarray] = []

    def _blocks(self, symbols: np.ndarray, n: int) -> Iterator[bytes]:
        words, first, states, places = self.table.encode(symbols)
        for b in range(len(symbols)):
            body = states[b].astype("<u8").tobytes() + words[first[b]:first[b + 1]].astype("<u4").tobytes()
            self.blocks.append((self.at, len(body), n, states.shape[1], zlib.crc32(body)))
            self.marks.append(places[b])
            self.at += len(body)
            yield body

    def bytes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        yield MAGIC
        docs, waiting, size, most = [], [], 0, BLOCKS_AT_ONCE * rans.BLOCK
        for batch in batches:
            docs.append(batch.select(["doc_id", "n_tokens"]))
            raw = b"".join(x.as_buffer() for x in batch.column("ids"))
            ids = np.frombuffer(raw, "<u4").astype(np.int32)
            self.tokens += len(ids)
            waiting.append(ids)
            size += len(ids)
            while size >= most:
                joined = np.concatenate(waiting)
                yield from self._blocks(joined[:most].reshape(BLOCKS_AT_ONCE, -1), rans.BLOCK)
                waiting, size = [joined[most:]], size - most
        joined = np.concatenate(waiting)
        whole = size // rans.BLOCK * rans.BLOCK
        if whole:
            yield from self._blocks(joined[:whole].reshape(-1, rans.BLOCK), rans.BLOCK)
        rest = joined[whole:]
        if len(rest):  # filled up to whole steps
            full = np.append(rest, np.full(-len(rest) % rans.LANES, rest[0], np.int32))
            yield from self._blocks(full[None, :], len(rest))
        names = ["offset", "length", "tokens", "marks", "crc32"]
        parts = [
            _ipc(pa.table({k: pa.array([b[i] for b in self.blocks], pa.int64()) for i, k in enumerate(names)})),
            _ipc(pa.table({"place": pa.array(np.concatenate(self.marks), pa.int64())})),
            _ipc(pa.Table.from_batches(docs))]
        footer = struct.pack("<3Q", *map(len, parts)) + b"".join(parts)
        yield footer + struct.pack("<QI", len(footer), zlib.crc32(footer)) + MAGIC


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row number of the unbroken run, rows): a task may read several runs."""
    first = following = None
    for batch in batches:
        rows = batch.column("row").to_numpy()
        cuts = np.append(0, np.append(np.flatnonzero(np.diff(rows) != 1) + 1, len(rows)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a < b:
                if rows[a] != following:
                    first = int(rows[a])
                following = int(rows[b - 1]) + 1
                yield first, batch.slice(a, b - a)


def write(df: DataFrame, path: str, folder: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the documents' ids, in ascending order of ``doc_id``, to files in
    ``folder``; returns the manifest (file, first token, tokens), a row a file."""
    spark = df.sparkSession
    # Ranges also cut within an id (or null id) that many texts share, by the texts' beginnings.
    ordered = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")) \
        .repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    # Row numbers ascend over partitions, so any run of rows knows its place.
    coded = stored(encode(ordered, path, tally=True).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    with releasing_shuffles(spark):
        counts = id_counts(coded)
    freq = rans.quantise(np.bincount(list(counts), weights=list(counts.values())) if counts else np.zeros(1))
    write_file(f"{folder}/table", [_table_bytes(freq)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _read_table(f"{folder}/table")
        for first, rows in groupby(_runs(batches), key=itemgetter(0)):
            out = _File(table)
            write_file(f"{folder}/ids-{first:016x}", out.bytes(batch for _, batch in rows))
            yield pa.RecordBatch.from_pydict({"first_row": [first], "tokens": [out.tokens]})

    with releasing_shuffles(spark):
        written = sorted(coded.drop("tally").mapInArrow(tidied(run), "first_row long, tokens long").collect())  # one small row a file
    drop(coded)
    starts = np.append(0, np.cumsum([r.tokens for r in written])).tolist()
    manifest = [(f"ids-{r.first_row:016x}", start, r.tokens) for r, start in zip(written, starts)]
    names = ["file", "start", "tokens"]
    write_file(f"{folder}/manifest", [_ipc(pa.table({n: [m[i] for m in manifest] for i, n in enumerate(names)}))])
    return spark.createDataFrame(manifest, "file string, start long, tokens long")


def _read_file(path: str, table: rans.Table, start: int) -> Iterator[pa.RecordBatch]:
    with open_file(path) as f:
        size = f.size()
        length, check = struct.unpack("<QI", f.read_at(12, size - 20))
        footer = f.read_at(length, size - 20 - length)
        if f.read_at(8, size - 8) != MAGIC or zlib.crc32(footer) != check:
            raise ValueError(f"{path}: damaged footer")
        at, parts = 24, []
        for n in struct.unpack("<3Q", footer[:24]):
            parts.append(pa.ipc.open_stream(footer[at:at + n]).read_all())
            at += n
        blocks, marks, docs = parts
        place = marks["place"].to_numpy()
        sizes, starts = docs["n_tokens"].to_numpy(), ragged(docs["n_tokens"].to_numpy())
        doc_ids = docs["doc_id"].combine_chunks()
        listed = blocks.to_pylist()
        waiting, mark, doc, i = np.zeros(0, "<u4"), 0, 0, 0
        while i < len(listed):
            group = [b for b in listed[i:i + BLOCKS_AT_ONCE] if b["tokens"] == listed[i]["tokens"]]
            raw = f.read_at(sum(b["length"] for b in group), group[0]["offset"])
            decoded, mark = _decode_blocks(path, raw, group, place, mark, table)
            waiting = np.append(waiting, decoded.astype("<u4"))
            i += len(group)
            done = starts[doc] + len(waiting)
            end = int(np.searchsorted(starts, done, side="right")) - 1
            if end > doc:
                cut = starts[end] - starts[doc]
                yield _documents(doc_ids, sizes, starts + start, waiting[:cut], doc, end)
                waiting, doc = waiting[cut:], end


def _decode_blocks(path: str, raw: bytes, group: list[dict], place: np.ndarray, mark: int, table: rans.Table):
    states, words, at, first = [], [], [], 0
    begin = group[0]["offset"]
    for b in group:
        body = raw[b["offset"] - begin:b["offset"] - begin + b["length"]]
        if zlib.crc32(body) != b["crc32"]:
            raise ValueError(f"{path}: damaged block at {b['offset']}")
        head = b["marks"] * rans.LANES * 8
        states.append(np.frombuffer(body[:head], "<u8").reshape(b["marks"], rans.LANES))
        words.append(np.frombuffer(body[head:], "<u4"))
        at.append(place[mark:mark + b["marks"]] + first)
        first += len(words[-1])
        mark += b["marks"]
    n, stream = group[0]["tokens"], np.concatenate(words)
    states, at = np.concatenate(states), np.concatenate(at)
    steps = -(-n // rans.LANES)
    if steps % rans.CHECKPOINT == 0:  # every segment is whole: all blocks side by side
        return table.decode(stream, states, at, rans.CHECKPOINT).reshape(-1), mark
    out = []  # the one short block of a file: its whole segments, then the rest
    whole = steps // rans.CHECKPOINT
    if whole:
        out.append(table.decode(stream, states[:whole], at[:whole], rans.CHECKPOINT).reshape(-1))
    out.append(table.decode(stream, states[whole:], at[whole:], steps - whole * rans.CHECKPOINT).reshape(-1))
    return np.concatenate(out)[:n], mark


def _documents(doc_ids, sizes, starts, ids, a, b) -> pa.RecordBatch:
    at = (starts[a:b + 1] - starts[a]) * 4
    binary = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), b - a, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids))])
    return pa.RecordBatch.from_arrays(
        [doc_ids.slice(a, b - a), pa.array(starts[a:b]), pa.array(sizes[a:b]), binary.cast(pa.binary())],
        ["doc_id", "start", "n_tokens", "ids"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files of ``folder``."""
    with open_file(f"{folder}/manifest") as f:
        manifest = pa.ipc.open_stream(f.read()).read_all().to_pylist()
    files = [(m["file"], m["start"]) for m in manifest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _read_table(f"{folder}/table")
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from _read_file(f"{folder}/{files[i][0]}", table, files[i][1])

    each = spark.range(0, len(files), 1, max(1, len(files)))  # a file a task
    return each.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids binary")
