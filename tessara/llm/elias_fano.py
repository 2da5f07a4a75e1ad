"""Elias-Fano sequences and a two-level n-gram trie of them, in memory-mapped files."""

from __future__ import annotations

import tempfile

import numpy as np

#: Elements between two samples; the unit of decoding.
STEP = 4096
#: Counts are kept exactly up to EXACT, above it as the lower end of bins that grow by RATIO; the last begins at 10^13.
EXACT, RATIO = 160, 1.3


def quantise(counts: np.ndarray) -> np.ndarray:
    above = EXACT + np.floor(np.log(np.maximum(counts, EXACT) / EXACT) / np.log(RATIO) + 1e-9)
    return np.minimum(np.where(counts <= EXACT, counts, above), 255).astype(np.uint8)


LEVELS = np.concatenate([np.arange(EXACT, dtype=np.float64), EXACT * RATIO ** np.arange(256 - EXACT)])


def mapped(array: np.ndarray) -> np.ndarray:
    """``array`` in a memory-mapped temporary file, which goes with its last user."""
    if not array.nbytes:
        return array
    with tempfile.TemporaryFile() as f:
        array.tofile(f)
        f.flush()
        return np.memmap(f, array.dtype, "r", shape=array.shape)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, and a sample every STEP elements."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        ones = high + np.arange(self.n)
        unary = np.zeros(int(ones[-1]) + 1 if self.n else 0, bool)
        unary[ones] = True
        self.first_one = ones[::STEP].copy()
        self.first = values[::STEP].copy()
        self.unary = mapped(np.packbits(unary))
        width = self.low_bits
        low = np.zeros(0, np.uint8)
        if width and self.n:
            parts = []
            for a in range(0, self.n, STEP):  # a step's low bits start at a byte
                bits = (values[a : a + STEP, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
                parts.append(np.packbits(bits.astype(bool).ravel()))
            low = np.concatenate(parts)
        self.low = mapped(low)

    def decode(self, step: int) -> np.ndarray:
        """The elements step * STEP and on, STEP at most."""
        a, b = step * STEP, min(self.n, (step + 1) * STEP)
        one = int(self.first_one[step])
        past = int(self.first_one[step + 1]) if step + 1 < len(self.first_one) else len(self.unary) * 8
        bits = np.unpackbits(self.unary[one // 8 : (past + 7) // 8])
        ones = np.flatnonzero(bits[one - one // 8 * 8 :])[: b - a] + one
        out = (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            begin = (STEP * self.low_bits + 7) // 8 * step
            size = (b - a) * self.low_bits
            low = np.unpackbits(self.low[begin : begin + (size + 7) // 8])[:size].reshape(b - a, self.low_bits)
            out |= low.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """Elements at ascending places."""
        out = np.zeros(len(places), np.uint64)
        edges = np.searchsorted(places // STEP, np.arange(len(self.first) + 1))
        for step in np.flatnonzero(np.diff(edges)):
            a, b = edges[step], edges[step + 1]
            out[a:b] = self.decode(step)[places[a:b] - step * STEP]
        return out

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Places of ascending values; -1 where a value is not in the sequence.

        Each is looked for only from its place ``begin`` to before ``end``, when given; both ascend too.
        """
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        if begin is None or end is None:
            begin, end = np.zeros(len(values), np.int64), np.full(len(values), self.n)
        step_of = np.clip(np.searchsorted(self.first, values, "right") - 1, begin // STEP, (end - 1) // STEP)
        edges = np.searchsorted(step_of, np.arange(len(self.first) + 1))
        for step in np.flatnonzero(np.diff(edges)):
            a, b = edges[step], edges[step + 1]
            own = self.decode(step)
            low, past = np.maximum(begin[a:b] - step * STEP, 0), np.minimum(end[a:b] - step * STEP, len(own))
            place = np.clip(np.searchsorted(own, values[a:b]), low, past - 1)
            out[a:b] = np.where(own[place] == values[a:b], place + step * STEP, -1)
        return out

    @property
    def nbytes(self) -> int:
        return self.unary.nbytes + self.low.nbytes + self.first.nbytes + self.first_one.nbytes


class Trie:
    """Contexts, pointers to their successors, and successors with quantised counts.

    A successor is kept relative to its context: the sequence of successors is
    made monotone by adding the place of the context times the universe. A
    search finds the context, reads where its successors begin and end from
    two pointers, and looks for the successor between them only.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, word_bits: int):
        """Distinct (context, word) pairs in ascending order."""
        new = np.ones(len(contexts), bool)
        new[1:] = contexts[1:] != contexts[:-1]
        begin = np.flatnonzero(new)
        self.word_bits = np.uint64(word_bits)
        self.contexts = EliasFano(contexts[begin])
        self.pointers = EliasFano(np.append(begin, len(contexts)))
        self.words = EliasFano((np.cumsum(new) - 1).astype(np.uint64) << self.word_bits | words.astype(np.uint64))
        self.codes = mapped(quantise(counts))

    def codes_of(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Count codes of ascending pairs; 0 for pairs that are not in the trie."""
        out = np.zeros(len(contexts), np.uint8)
        if not self.contexts.n or not len(contexts):
            return out
        new = np.ones(len(contexts), bool)
        new[1:] = contexts[1:] != contexts[:-1]
        place = self.contexts.find(contexts[new])
        seen = place >= 0
        begin, end = np.zeros((2, len(place)), np.int64)
        begin[seen], end[seen] = (self.pointers.at(place[seen] + k) for k in range(2))
        own = np.cumsum(new) - 1
        known = np.flatnonzero(seen[own])
        own = own[known]
        relative = place[own].astype(np.uint64) << self.word_bits | words[known].astype(np.uint64)
        at = self.words.find(relative, begin[own], end[own])
        found = at >= 0
        out[known[found]] = self.codes[at[found]]
        return out

    def successors(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """All successors of one context and their count codes."""
        place = int(self.contexts.find(np.array([context], np.uint64))[0])
        if place < 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        a, b = self.pointers.at(np.array([place, place + 1])).astype(np.int64)
        words = self.words.at(np.arange(a, b)) & ((np.uint64(1) << self.word_bits) - np.uint64(1))
        return words, np.asarray(self.codes[a:b])
