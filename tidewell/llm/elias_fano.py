"""Elias-Fano sequences and a two-level n-gram trie over them, all in flat arrays that can be memory-mapped."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit; before[i]: set bits ahead of word i."""
    word = np.searchsorted(before, k, side="right") - 1
    rest = (k - before[word]).astype(np.int64)
    bits = words[word]
    at = np.zeros(len(k), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = bits & np.uint64((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        beyond = rest >= n
        rest -= np.where(beyond, n, 0)
        at += np.where(beyond, width, 0)
        bits = np.where(beyond, bits >> np.uint64(width), low)
    return word * 64 + at


class EliasFano:
    """A non-decreasing sequence of integers below universe, in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self._ones = np.concatenate([[0], np.cumsum(ones)])[:-1] if len(high) else np.zeros(0, np.int64)
        self._zeros = np.arange(len(high), dtype=np.int64) * 64 - self._ones
        self._empty = ~high

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """From values in order, each below universe (at most 2 ** 63)."""
        n = len(values)
        values = values.astype(np.uint64)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        buckets = (max(1, universe) >> bits) + 1
        high = np.zeros((n + buckets) // 64 + 1, dtype=np.uint64)
        if n:
            place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
            np.bitwise_or.at(high, place >> 6, _ONE << (place & 63).astype(np.uint64))
        return cls(n, bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > np.uint64(64)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (_select(self.high, self._ones, i) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value >= x; n where there is none.  x must be below the universe.

        With low and high, of those at low to high - 1; high where there is none.
        """
        x = np.asarray(x, dtype=np.uint64)
        if not len(x) or not self.n:
            return np.full(len(x), self.n, np.int64)
        bucket = (x >> np.uint64(self.low_bits)).astype(np.int64)
        # Values with this high part stand between two zeros of the high bits.
        end = _select(self._empty, self._zeros, bucket) - bucket
        start = np.zeros(len(x), np.int64)
        later = bucket > 0
        start[later] = _select(self._empty, self._zeros, bucket[later] - 1) - (bucket[later] - 1)
        if low is not None:
            start, end = np.clip(start, low, high), np.clip(end, low, high)
        sought = x & np.uint64((1 << self.low_bits) - 1)
        while (open_ := start < end).any():
            rows = np.flatnonzero(open_)
            middle = (start[rows] + end[rows]) // 2
            less = self._low(middle) < sought[rows]
            start[rows[less]] = middle[less] + 1
            end[rows[~less]] = middle[~less]
        return start

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x, or -1 where it isn't in the sequence."""
        at = self.successor(x)
        inside = np.flatnonzero(at < self.n)
        out = np.full(len(x), -1, np.int64)
        good = self.access(at[inside]) == np.asarray(x, dtype=np.uint64)[inside]
        out[inside[good]] = at[inside[good]]
        return out

    def arrays(self) -> list[np.ndarray]:
        """All there is, for storage."""
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high)], dtype=np.uint64), self.low, self.high]

    @classmethod
    def read(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """From 64-bit words at a place, as views; also gives the place after it."""
        n, bits, low, high = (int(v) for v in data[at : at + 4])
        return cls(n, bits, data[at + 4 : at + 4 + low], data[at + 4 + low : at + 4 + low + high]), at + 4 + low + high


#: Probabilities are kept as their log10, from -16 to 0, in 16 bits; 0 stands for none.
_DEEPEST, _STEPS = -16.0, 65534


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities over 0."""
    return (np.rint((1 - np.maximum(np.log10(p), _DEEPEST) / _DEEPEST) * _STEPS) + 1).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    """The probabilities of codes; 0 for code 0."""
    return np.where(code == 0, 0.0, 10.0 ** ((1 - (code.astype(float) - 1) / _STEPS) * _DEEPEST))


class NgramTrie:
    """Contexts, pointers to their successors, and the successors with quantised probabilities.

    A successor is kept relative to its context: word + context's rank * width,
    which makes one monotone sequence of all.  A look-up finds the context, reads
    from the pointers where its successors stand, and searches among these.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, width: int):
        self.contexts, self.pointers, self.successors, self.codes, self.width = contexts, pointers, successors, codes, width

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, probability: np.ndarray) -> NgramTrie:
        """From distinct (context, word) in order; ids are not negative."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(context)]])))
        width = int(word.max(initial=0)) + 1
        if len(first) * width >= 1 << 62:
            raise ValueError("too many contexts for one trie: use more shards")
        return cls(
            EliasFano.build(context[first], int(context.max(initial=0)) + 1),
            EliasFano.build(np.concatenate([first, [len(context)]]), len(context) + 1),
            EliasFano.build(rank.astype(np.int64) * width + word.astype(np.int64), max(1, len(first) * width)),
            quantise(probability),
            width,
        )

    def codes_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability codes of n-grams; 0 for those not in the trie."""
        out = np.zeros(len(context), np.uint16)
        fits = np.flatnonzero(self._fits(self.contexts, context) & (word < self.width))
        rank = self.contexts.find(context[fits])
        fits, rank = fits[rank >= 0], rank[rank >= 0]
        low, high = self.pointers.access(rank).astype(np.int64), self.pointers.access(rank + 1).astype(np.int64)
        sought = rank * self.width + word[fits].astype(np.int64)
        at = self.successors.successor(sought, low, high)
        inside = np.flatnonzero(at < high)
        inside = inside[self.successors.access(at[inside]).astype(np.int64) == sought[inside]]
        out[fits[inside]] = self.codes[at[inside]]
        return out

    def successors_of(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """Words that follow a context, with their probability codes."""
        rank = self.contexts.find(np.array([context])) if self._fits(self.contexts, np.array([context]))[0] else np.array([-1])
        if rank[0] < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint16)
        low, high = self.pointers.access(np.array([rank[0], rank[0] + 1])).astype(np.int64).tolist()
        return self.successors.access(np.arange(low, high)).astype(np.int64) - rank[0] * self.width, self.codes[low:high]

    @staticmethod
    def _fits(sequence: EliasFano, x: np.ndarray) -> np.ndarray:
        """Whether x is no larger than the last value."""
        if not sequence.n:
            return np.zeros(len(x), bool)
        return x <= int(sequence.access(np.array([sequence.n - 1]))[0])

    def to_bytes(self) -> bytes:
        """One flat image."""
        codes = np.concatenate([self.codes, np.zeros(-len(self.codes) % 4, np.uint16)]).view(np.uint64)
        parts = [np.array([self.width, len(self.codes)], dtype=np.uint64), *self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(), codes]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_buffer(cls, buffer) -> NgramTrie:
        """Views over an image: bytes, or a numpy memmap of 64-bit words."""
        data = buffer if isinstance(buffer, np.ndarray) else np.frombuffer(buffer, dtype=np.uint64)
        width, n = int(data[0]), int(data[1])
        contexts, at = EliasFano.read(data, 2)
        pointers, at = EliasFano.read(data, at)
        successors, at = EliasFano.read(data, at)
        return cls(contexts, pointers, successors, data[at : at + -(-n // 4)].view(np.uint16)[:n], width)

    @classmethod
    def open(cls, file) -> NgramTrie:
        """Memory-maps an image that to_bytes() made: the file's path, or the open file."""
        return cls.from_buffer(np.memmap(file, dtype=np.uint64, mode="r"))
