"""Elias-Fano sequences in memory-mapped files, queried for whole arrays at a time.

A monotone sequence of n numbers below u keeps the low log2(u / n) bits of each number as they
are and the rest in unary: about log2(u / n) + 2 bits a number, and both the i-th number and
the place of a given number are found without unpacking.
"""

import numpy as np

BLOCK = 8  # 64-bit words of the unary part per directory entry
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Place of the k-th set bit of a byte.
IN_BYTE = np.argsort(1 - _BITS.astype(np.int8), axis=1, kind="stable").astype(np.int64)


class Sequence:
    """Views of the parts of one sequence; `parts` lists what `build` made, in its order."""

    def __init__(self, n: int, low_bits: int, parts):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.ones, self.zeros = parts

    @staticmethod
    def build(values: np.ndarray, universe: int) -> tuple["Sequence", list[np.ndarray]]:
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        tops = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + (universe >> low_bits) + 1
        bits = np.zeros(-(-size // (64 * BLOCK)) * 64 * BLOCK, bool)
        bits[tops + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).astype(np.int64).reshape(-1, BLOCK).sum(1)
        before = np.concatenate([[0], np.cumsum(ones)])[:-1]
        zeros = np.arange(len(before)) * 64 * BLOCK - before
        parts = [_packed(values, low_bits), high, before.astype("<u8"), zeros.astype("<u8")]
        return Sequence(n, low_bits, parts), parts

    def lows(self, at: np.ndarray) -> np.ndarray:
        """Low bits of the numbers at places `at`."""
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        found = self.low[word] >> shift
        # The next word's bits, shifted in two steps because a shift by 64 has no meaning.
        found |= (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return found & np.uint64((1 << self.low_bits) - 1)

    def _select(self, rank: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the rank-th (from 0) set bits, or clear ones with `flip`, of the unary part."""
        block = np.searchsorted(directory, rank.astype(np.uint64), "right") - 1
        rest = rank - directory[block].astype(np.int64)
        words = self.high.reshape(-1, BLOCK)[block]
        if flip:
            words = ~words
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        k = (upto <= rest[:, None]).sum(1)
        rows = np.arange(len(rank))
        rest = rest - np.where(k > 0, upto[rows, k - 1], 0)
        word = np.ascontiguousarray(words[rows, k]).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(word), axis=1, dtype=np.int64)
        j = (upto <= rest[:, None]).sum(1)
        rest = rest - np.where(j > 0, upto[rows, j - 1], 0)
        return (block * BLOCK + k) * 64 + j * 8 + IN_BYTE[word[rows, j], rest]

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at places `at`."""
        tops = self._select(at, self.ones, False) - at
        return (tops.astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of the given numbers, -1 where the sequence lacks one.

        Numbers with the same high part are neighbours: the unary part gives their range, and a
        binary search over low parts the place.
        """
        found = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return found
        tops = (values >> np.uint64(self.low_bits)).astype(np.int64)
        lows = values & np.uint64((1 << self.low_bits) - 1)
        hi = self._select(tops, self.zeros, True) - tops
        lo = np.zeros(len(values), np.int64)
        some = tops > 0
        lo[some] = self._select(tops[some] - 1, self.zeros, True) - (tops[some] - 1)
        open_ = np.flatnonzero(lo < hi)
        lo, hi, lows = lo[open_], hi[open_], lows[open_]
        while len(open_):
            mid = (lo + hi) >> 1
            at = self.lows(mid)
            found[open_[at == lows]] = mid[at == lows]
            less = at < lows
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            keep = (lo < hi) & (at != lows)
            open_, lo, hi, lows = open_[keep], lo[keep], hi[keep], lows[keep]
        return found


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low `bits` bits of every value, one after the other, and a spare word."""
    words = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits:
        low = values & np.uint64((1 << bits) - 1)
        at = np.arange(len(values), dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # Values whose bits begin in one word are neighbours: or them in one go.
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, int)
        if len(word):
            words[word[starts]] |= np.bitwise_or.reduceat(low << shift, starts)
            over = (low >> np.uint64(1)) >> (np.uint64(63) - shift)
            words[word[starts] + 1] |= np.bitwise_or.reduceat(over, starts)
    return words
