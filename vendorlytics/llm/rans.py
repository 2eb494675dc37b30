"""Range asymmetric numeral system with a static table, for integer symbols.

A block's symbols are dealt over ``LANES`` interleaved states of 64 bits, which
share one stream of 32-bit words: step s codes symbols s * LANES to
(s + 1) * LANES - 1.  Blocks are independent.  Every ``CHECKPOINT`` steps a block
notes the states and the place in its stream, so that its segments decode side
by side; numpy works on all lanes of all segments (or blocks) at once.
"""

from __future__ import annotations

import numpy as np

SCALE = 18
LANES = 32
CHECKPOINT = 256
BLOCK = LANES * CHECKPOINT * 8
LOOKED_UP = 32
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_SCALE, _MASK = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 wherever the count is."""
    counts = np.asarray(counts, np.float64)
    used = counts > 0
    if used.sum() > 1 << SCALE:
        raise ValueError(f"more than {1 << SCALE} different symbols")
    if not used.any():
        return np.zeros(len(counts), np.int64)
    spare = (1 << SCALE) - int(used.sum())
    share = counts / counts.sum() * spare
    freq = np.where(used, 1 + np.floor(share), 0).astype(np.int64)
    rest = (1 << SCALE) - int(freq.sum())
    order = np.lexsort((np.arange(len(counts)), -(share - np.floor(share))))
    order = order[used[order]]
    freq[order[:rest]] += 1
    return freq


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint64)
        self.start = np.append(0, np.cumsum(self.freq)[:-1]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), np.asarray(freq, np.int64))
        self.inverse = 1.0 / np.maximum(self.freq, 1).astype(np.float64)

    def encode(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Encode blocks of equal length, ``symbols`` of shape (blocks, steps * LANES).

        Returns the words of all blocks, each block's first word (one more than
        blocks), the states (blocks, checkpoints, LANES) and the places in the
        block's words (blocks, checkpoints) at each checkpoint.
        """
        blocks, n = symbols.shape
        steps = n // LANES
        by_step = np.ascontiguousarray(symbols.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
        x = np.full(blocks * LANES, _LOW, np.uint64)
        emitted = np.zeros((steps, blocks * LANES), bool)
        words = np.zeros((steps, blocks * LANES), np.uint32)
        marks = -(-steps // CHECKPOINT)
        states = np.zeros((marks, blocks * LANES), np.uint64)
        for s in range(steps - 1, -1, -1):
            at = s % LOOKED_UP
            if at == LOOKED_UP - 1 or s == steps - 1:  # the table's values for some steps at once
                syms = by_step[s - at:s + 1]
                freq, start, inverse = self.freq[syms], self.start[syms], self.inverse[syms]
                limit, signed = freq << np.uint64(63 - SCALE), freq.astype(np.int64)
            f = freq[at]
            over = x >= limit[at]
            emitted[s] = over
            words[s] = x  # the low 32 bits
            x = np.where(over, x >> _WORD, x)
            q = (x * inverse[at]).astype(np.uint64)  # within one of x // f
            r = (x - q * f).astype(np.int64)
            q = q - (r < 0) + (r >= signed[at])
            x = (q << _SCALE) + (x - q * f) + start[at]
            if s % CHECKPOINT == 0:
                states[s // CHECKPOINT] = x
        kept = emitted.reshape(steps, blocks, LANES).transpose(1, 0, 2)
        stream = words.reshape(steps, blocks, LANES).transpose(1, 0, 2)[kept]
        per_step = np.cumsum(kept.sum(2), axis=1)
        first = np.append(0, np.cumsum(per_step[:, -1])) if steps else np.zeros(blocks + 1, np.int64)
        places = np.concatenate([np.zeros((blocks, 1), np.int64), per_step[:, CHECKPOINT - 1:steps - 1:CHECKPOINT]], 1)
        return stream, first, states.reshape(marks, blocks, LANES).transpose(1, 0, 2), places[:, :marks]

    def decode(self, stream: np.ndarray, states: np.ndarray, places: np.ndarray, steps: int) -> np.ndarray:
        """Decode segments of ``steps`` steps side by side: ``states`` (segments,
        LANES), ``places`` the index of each segment's next word in ``stream``."""
        segments = len(places)
        x = states.astype(np.uint64).reshape(-1)
        at = np.asarray(places, np.int64).copy()
        stream = np.append(stream, np.uint32(0)).astype(np.uint64)
        out = np.empty((steps, segments * LANES), np.int32)
        for s in range(steps):
            slot = x & _MASK
            sym = self.symbol[slot.astype(np.int64)]
            out[s] = sym
            x = self.freq[sym] * (x >> _SCALE) + slot - self.start[sym]
            low = (x < _LOW).reshape(segments, LANES)
            taken = np.cumsum(low, axis=1)
            place = np.minimum((at[:, None] + taken - 1).reshape(-1), len(stream) - 1)
            x = np.where(low.reshape(-1), (x << _WORD) | stream[place], x)
            at += taken[:, -1]
        return out.reshape(steps, segments, LANES).transpose(1, 0, 2).reshape(segments, -1)
