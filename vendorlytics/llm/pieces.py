"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding: the text's characters are symbols; an agenda (priority queue) holds
every pair of adjacent symbols whose concatenation is a piece, ordered by the
piece's score, then by position.  The best pair is merged, the pairs with the
new symbol's neighbours join the agenda, and stale entries are skipped, until
the agenda is empty.  Characters outside the vocabulary become byte pieces.

No merge crosses two neighbouring bytes that stand together in no piece (such
as a letter and the space after it).  Texts are cut at those places into chunks;
each Arrow slice encodes its distinct chunks once.  The chunks that a worker meets for the first time are checked
against the sentencepiece library, and a difference raises.

Defined results: a null or empty text has no ids and decodes to empty text;
rows, ties and repeats are independent of one another; other columns are kept
as they are (a column with the name of the result is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vendorlytics.llm.text import SLICE_BYTES, ChunkCache, chunk_array, ragged, slices, text_bytes, tidied

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
# An agenda entry is one integer: the piece's rank by score, the left symbol's
# position, the joined length.
RANK, PLACE = 48, 12
NEVER, GONE, UNKNOWN_SYMBOL = np.int32(2**31 - 1), -1, (1 << 20) - 1
# Texts of up to so many characters are merged side by side, in these groups.
SIDE_BY_SIDE = (6, 10, 16, 32)


class PieceModel:
    """Scores and ids of a merge-type vocabulary file."""

    def __init__(self, path: str, checked: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix \
                or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("needs a merge-type vocabulary with byte fallback and no user-defined pieces")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix \
                or not spec.escape_whitespaces:
            raise ValueError("needs identity normalisation with a space put in front")
        self.ids, self.order, self.byte = {}, {}, [0] * 256
        scores = sorted({-p.score for p in model.pieces if p.type == NORMAL})
        rank = {score: r for r, score in enumerate(scores)}
        shown: list[bytes] = []
        for i, p in enumerate(model.pieces):
            shown.append(p.piece.replace(MARK, " ").encode())
            if p.type == NORMAL:
                self.ids[p.piece] = i
                self.order[p.piece] = rank[-p.score] << RANK | len(p.piece)
            elif p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte[value] = i
                shown[-1] = bytes([value])
            elif p.type == CONTROL:
                shown[-1] = b""
            else:
                shown[-1] = " ⁇ ".encode()
        self.shown = pa.array(shown, pa.large_binary())
        self.together = np.zeros((256, 256), bool)
        for p in self.order:
            raw = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
            self.together[raw[:-1], raw[1:]] = True
        self.together[:, 0x80:0xC0] = True  # never inside a character
        if self.together[:, 10].any() or self.together[10, :0x80].any():
            raise ValueError("needs a vocabulary whose pieces don't go on after a line feed")
        self._pairs()
        self.checked = checked
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache = ChunkCache(self.encode_chunks)

    def agenda(self, text: str) -> list[str]:
        """Merge the characters of ``text`` into pieces, best score first."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        known = self.order.get
        entries = map(known, map(add, symbols, symbols[1:]))
        heap = [e + (i << PLACE) for i, e in enumerate(entries) if e is not None]
        if not heap:
            return symbols
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(None)
        while heap:
            entry = heappop(heap)
            i = entry >> PLACE & (1 << RANK - PLACE) - 1
            left, j = symbols[i], after[i]
            right = symbols[j]
            if left is None or right is None or len(left) + len(right) != entry & (1 << PLACE) - 1:
                continue  # one of the two was merged meanwhile
            joined = symbols[i] = left + right
            symbols[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                entry = known(joined + symbols[k])
                if entry is not None:
                    heappush(heap, entry + (i << PLACE))
            h = before[i]
            if h >= 0:
                entry = known(symbols[h] + joined)
                if entry is not None:
                    heappush(heap, entry + (h << PLACE))
        return [s for s in symbols if s is not None]

    def _pairs(self) -> None:
        """Sorted keys of all (left, right) symbols that join to a piece."""
        symbol = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            symbol.setdefault(c, len(self.shown) + len(symbol))
        self.symbol = np.full(0x110000, UNKNOWN_SYMBOL, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        joins = sorted((symbol[p[:k]] << 20 | symbol[p[k:]], self.order[p] >> RANK, i)
                       for p, i in self.ids.items() for k in range(1, len(p))
                       if p[:k] in symbol and p[k:] in symbol)
        self.pair, self.pair_rank, self.pair_piece = (np.array(x) for x in zip(*joins))
        self.pair_rank, self.pair_piece = self.pair_rank.astype(np.int32), self.pair_piece.astype(np.int32)

    def _join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; rank NEVER if they join to none."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NEVER), self.pair_piece[at]

    def agendas(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many short texts side by side: row t of ``rank`` is the
        agenda of text t, and each turn takes every row's best pair (the leftmost
        of equals).  Returns the symbols by place (GONE where merged away)."""
        n, wide = len(lengths), int(lengths.max())
        place = np.arange(wide)
        inside = place < lengths[:, None]
        out = np.full((n, wide), GONE, np.int32)
        out[inside] = self.symbol[points]
        rank, piece = np.full((n, wide), NEVER, np.int32), np.zeros((n, wide), np.int32)
        both = inside[:, 1:]
        rank[:, :-1][both], piece[:, :-1][both] = self._join(out[:, :-1][both], out[:, 1:][both])
        after = np.tile(place + 1, (n, 1)).astype(np.int8)
        before = np.tile(place - 1, (n, 1)).astype(np.int8)
        rows = np.arange(n)
        while len(rows):
            i = rank[rows].argmin(1)
            going = rank[rows, i] < NEVER
            rows, i = rows[going], i[going]
            j = after[rows, i]
            joined = out[rows, i] = piece[rows, i]
            out[rows, j] = GONE
            rank[rows, j] = NEVER
            k = after[rows, i] = after[rows, j]
            rank[rows, i] = NEVER
            has = k < lengths[rows]
            r, at, to = rows[has], i[has], k[has]
            before[r, to] = at
            rank[r, at], piece[r, at] = self._join(joined[has], out[r, to])
            h = before[rows, i]
            has = h >= 0
            r, at = rows[has], h[has]
            rank[r, at], piece[r, at] = self._join(out[r, at], joined[has])
        return out, inside

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode() for c in chunks]
        out: list[bytes] = [b""] * len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        low = 0
        for wide in SIDE_BY_SIDE:
            some = np.flatnonzero((sizes > low) & (sizes <= wide))
            low = wide
            if not len(some):
                continue
            joined = "".join(texts[t] for t in some).replace(" ", MARK)
            symbols, _ = self.agendas(np.frombuffer(joined.encode("utf-32-le"), np.uint32), sizes[some])
            alive = symbols != GONE
            flat, ends = symbols[alive].astype(np.int32), ragged(alive.sum(1)) * 4
            strange = (symbols >= len(self.shown)).any(1)
            raw = flat.tobytes()
            for t, a, b in zip(some.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                out[t] = raw[a:b]
            for t in some[strange].tolist():  # characters that only their bytes can express
                out[t] = self._ids(self.agenda(texts[t].replace(" ", MARK)))
        for t in np.flatnonzero(sizes > low).tolist():
            out[t] = self._ids(self.agenda(texts[t].replace(" ", MARK)))
        if self.checked:
            self.check(texts, out)
        return out

    def _ids(self, found: list[str]) -> bytes:
        row = []
        for piece in found:
            i = self.ids.get(piece)
            row += [i] if i is not None else [self.byte[b] for b in piece.encode()]
        return np.array(row, np.int32).tobytes()

    def check(self, texts: list[str], coded: list[bytes]) -> None:
        """Compare with the library, which puts a space in front of what it gets:
        a chunk's own first space is left off, and a chunk without one follows a
        line feed that is encoded by itself."""
        asked = [t[1:] if t[0] == " " else t if t == "\n" else "\n" + t for t in texts if t != " "]
        skip = [0 if t[0] == " " else 1 if t == "\n" else 2 for t in texts if t != " "]
        coded = [c for t, c in zip(texts, coded) if t != " "]
        texts = [t for t in texts if t != " "]
        for text, own, k, ids in zip(texts, coded, skip, self.library.encode(asked, num_threads=1)):
            if np.array(ids[k:], np.int32).tobytes() != own:
                raise ValueError(f"agenda and library differ on {text!r}")

    def encode(self, column: pa.Array) -> pa.LargeListArray:
        data, offsets = text_bytes(column)
        if b"\xe2\x96\x81" in data.tobytes():  # the space mark itself reads as a space
            column = pc.replace_substring(column.fill_null(""), MARK, " ")
            data, offsets = text_bytes(column)
        full = offsets[:-1] < offsets[1:]
        return self.encode_spaced(np.insert(data, offsets[:-1][full], 32), offsets + np.append(0, np.cumsum(full)))

    def encode_spaced(self, data: np.ndarray, offsets: np.ndarray) -> pa.LargeListArray:
        """ids of texts that already have the space in front."""
        begins = np.zeros(len(data), bool)
        begins[1:] = ~self.together[data[:-1], data[1:]]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        lists = self.cache.ids(chunk_array(data, starts))
        sizes = np.diff(lists.offsets.to_numpy())
        ends = ragged(sizes)
        docs = ends[np.searchsorted(starts, offsets)]
        return pa.LargeListArray.from_arrays(pa.array(docs), lists.flatten())

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of id lists, as the library's decode(ids) gives them: the space
        in front goes, and bytes that are no UTF-8 read as replacement marks."""
        ids = ids.fill_null([]) if ids.null_count else ids
        lists = pa.LargeListArray.from_arrays(
            pa.array(ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()), ids.flatten())
        shown = self.shown.take(lists.values)
        if isinstance(shown, pa.ChunkedArray):
            shown = shown.combine_chunks()
        at = np.frombuffer(shown.buffers()[1], np.int64)[shown.offset:shown.offset + len(shown) + 1]
        data = np.frombuffer(shown.buffers()[2] or b"", np.uint8)
        bounds = at[lists.offsets.to_numpy()]
        begin, end = bounds[:-1].copy(), bounds[1:]
        some = begin < end
        begin[some] += data[begin[some]] == 32
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(begin, end)], pa.string())


@lru_cache(maxsize=4)
def model(path: str, checked: bool = True) -> PieceModel:
    return PieceModel(path, checked)


def _replaced(batch: pa.RecordBatch, names: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    columns = [values if n == name else batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays(columns, names)


def _with_column(df: DataFrame, name: str, kind: str):
    """Schema of ``df`` with one column put last (or replaced)."""
    from pyspark.sql import types as T

    fields = [f for f in df.schema.fields if f.name != name]
    return T.StructType([*fields, T.StructField(name, T._parse_datatype_string(kind))])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the column ``ids`` (array of int): the piece ids of each whole text; and,
    if asked for, ``decoded``: the text that these ids decode to."""
    schema = _with_column(df, ids, "array<int>")
    if decoded:
        schema = schema.add(decoded, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        try:
            for batch in batches:
                for part in slices(batch, text):
                    coded = m.encode(part.column(text))
                    new = {ids: coded.cast(pa.list_(pa.int32()))}
                    if decoded:
                        new[decoded] = m.decode(coded)
                    yield pa.RecordBatch.from_arrays(
                        [new[n] if n in new else part.column(n) for n in schema.names], schema.names)
        finally:
            m.cache.clear()

    return df.mapInArrow(tidied(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the column ``text``: the text of each row's piece ids."""
    schema = _with_column(df, text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            sizes = pc.list_value_length(batch.column(ids)).fill_null(0).to_numpy()
            group = np.cumsum(sizes) // SLICE_BYTES
            for at, end in _runs(group):
                part = batch.slice(at, end - at)
                yield _replaced(part, schema.names, text, m.decode(part.column(ids)))

    return df.mapInArrow(tidied(run), schema)


def _runs(group: np.ndarray) -> Iterator[tuple[int, int]]:
    if not len(group):
        return
    cuts = np.flatnonzero(np.diff(group)) + 1
    yield from zip(np.append(0, cuts).tolist(), np.append(cuts, len(group)).tolist())
