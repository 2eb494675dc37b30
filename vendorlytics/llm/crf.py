"""Linear-chain conditional random field with two labels, in numpy.

A step from token t - 1 to t has the matrix ``transition * diag(1, exp(e_t))``; the
chain starts from ``(1, exp(start))`` with the first token's emission.  Texts are
cut into segments of ``SEGMENT`` tokens.  The product of each segment's matrices,
taken for all segments side by side, gives the messages at the segments' ends;
from there the messages inside run forward and backward, again side by side.  The
marginals are exact for texts of any length.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 64


class Chains:
    """Forward-backward over the tokens of some texts, ``first`` being the texts'
    first tokens (one more than texts)."""

    def __init__(self, first: np.ndarray):
        lengths = np.diff(first)
        self.texts = np.flatnonzero(lengths)
        lengths = lengths[self.texts]
        self.segments = -(-lengths // SEGMENT)
        self.seg_first = np.append(0, np.cumsum(self.segments))
        text = np.repeat(np.arange(len(lengths)), self.segments)
        turn = np.arange(self.seg_first[-1]) - self.seg_first[text]
        begin = first[:-1][self.texts][text] + turn * SEGMENT
        size = np.minimum(SEGMENT, lengths[text] - turn * SEGMENT)
        place = np.arange(SEGMENT)
        self.inside = place < size[:, None]
        self.token = np.where(self.inside, begin[:, None] + place, 0)
        self.opens = (turn == 0)

    def run(self, emission: np.ndarray, transition: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of label 1, and the expected transitions (2, 2)."""
        n = len(self.inside)
        out = np.zeros(len(emission))
        if not n:
            return out, np.zeros((2, 2))
        gain = np.exp(np.clip(emission, -30, 30))[self.token]
        steps = np.empty((SEGMENT, 2, 2, n))
        for i in range(2):
            steps[:, i, 0] = transition[i, 0]
            steps[:, i, 1] = (transition[i, 1] * gain).T
        # A text's first step has no predecessor: whatever came before, it starts anew.
        steps[0, :, 0, self.opens] = 1.0
        steps[0, :, 1, self.opens] = (np.exp(start) * gain[self.opens, 0])[:, None]
        pad = ~self.inside.T
        for i in range(2):
            for j in range(2):
                steps[:, i, j][pad] = float(i == j)
        whole = np.stack([np.stack([np.ones(n), np.zeros(n)]), np.stack([np.zeros(n), np.ones(n)])])
        for t in range(SEGMENT):
            whole = np.stack([np.stack([whole[i, 0] * steps[t, 0, j] + whole[i, 1] * steps[t, 1, j] for j in range(2)])
                              for i in range(2)])
            whole /= whole.max((0, 1))
        ahead, back = np.empty((2, n)), np.empty((2, n))
        most = int(self.segments.max())
        live = np.arange(len(self.segments))
        v = np.full((2, len(live)), 0.5)
        for k in range(most):
            go = self.segments[live] > k
            live, v = live[go], v[:, go]
            s = self.seg_first[live] + k
            ahead[:, s] = v
            v = np.stack([v[0] * whole[0, j, s] + v[1] * whole[1, j, s] for j in range(2)])
            v /= v.sum(0)
        live = np.arange(len(self.segments))
        v = np.full((2, len(live)), 0.5)
        for k in range(most):
            go = self.segments[live] > k
            live, v = live[go], v[:, go]
            s = self.seg_first[live + 1] - 1 - k
            back[:, s] = v
            v = np.stack([whole[i, 0, s] * v[0] + whole[i, 1, s] * v[1] for i in range(2)])
            v /= v.sum(0)
        forward = np.empty((SEGMENT + 1, 2, n))
        forward[0] = ahead
        for t in range(SEGMENT):
            f = np.stack([forward[t, 0] * steps[t, 0, j] + forward[t, 1] * steps[t, 1, j] for j in range(2)])
            forward[t + 1] = f / f.sum(0)
        expected = np.zeros((2, 2))
        b = back
        for t in range(SEGMENT - 1, -1, -1):
            both = forward[t + 1] * b
            ok = self.inside[:, t]
            out[self.token[ok, t]] = (both[1] / both.sum(0))[ok]
            linked = ok & ~self.opens if t == 0 else ok
            pair = np.stack([np.stack([forward[t, i] * steps[t, i, j] * b[j] for j in range(2)]) for i in range(2)])
            pair = pair / pair.sum((0, 1))
            expected += pair[:, :, linked].sum(2)
            b = np.stack([steps[t, i, 0] * b[0] + steps[t, i, 1] * b[1] for i in range(2)])
            b = b / b.sum(0)
        return out, expected


def observed_transitions(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    pairs = np.ones(max(0, len(labels) - 1), bool)
    cut = first[1:-1] - 1
    pairs[cut[(cut >= 0) & (cut < len(pairs))]] = False
    a, b = labels[:-1][pairs], labels[1:][pairs]
    return np.array([[np.sum((a == i) & (b == j)) for j in range(2)] for i in range(2)], float)
