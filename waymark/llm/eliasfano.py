"""Elias-Fano sequences: sorted integers in about ``2 + log2(U / n)`` bits each.

The low bits lie packed side by side; the high bits are written in unary into a
bit vector. Samples of the zeros and ones make both directions quick: the value
at a position, and the position of a value. All operations take arrays.
"""

from __future__ import annotations

import numpy as np

_SAMPLE = 3
_TOPS = np.uint64(0x8080808080808080)
_ONES = np.uint64(0x0101010101010101)
_EIGHT = np.arange(8)
#: The place of the r-th one of a byte b, at 8 * b + r.
_IN_BYTE = np.array(
    [np.append(np.flatnonzero(b >> _EIGHT & 1), _EIGHT)[:8] for b in range(256)], np.int64
).ravel()


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, side by side in 64-bit words."""
    if bits == 0 or len(values) == 0:
        return np.zeros(2, np.uint64)
    values = values & np.uint64((1 << bits) - 1)
    at = np.arange(len(values)) * bits
    off = (at & 63).astype(np.uint64)
    at >>= 6
    # As many bits as a word has at most, so a value begins in every word.
    begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out = np.zeros(-(-len(values) * bits // 64) + 1, np.uint64)
    out[: len(begins)] = np.bitwise_or.reduceat(values << off, begins)
    over = (values >> np.uint64(1)) >> (np.uint64(63) - off)
    out[1 : len(begins) + 1] |= np.bitwise_or.reduceat(over, begins)[: len(out) - 1]
    return out


def _nth_one(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the ``n``-th one of each word, from byte counts side by side."""
    sums = value - (value >> np.uint64(1) & np.uint64(0x5555555555555555))
    pairs = np.uint64(0x3333333333333333)
    sums = (sums & pairs) + (sums >> np.uint64(2) & pairs)
    sums = (sums + (sums >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES
    n = n.astype(np.uint64)
    # Bytes with no more ones up to their end than n come before its byte.
    before = np.bitwise_count((n * _ONES | _TOPS) - sums & _TOPS).astype(np.uint64)
    before <<= np.uint64(3)
    n -= (sums << np.uint64(8)) >> before & np.uint64(255)
    byte = value >> before & np.uint64(255)
    return before.astype(np.int64) + _IN_BYTE[(byte << np.uint64(3) | n).astype(np.int64)]


class EliasFano:
    """Made by ``build``, kept as a list of arrays, opened by ``__init__``."""

    def __init__(self, arrays: list[np.ndarray]):
        head, self.low, self.bits, ones, self.zero_at, self.one_at = arrays
        self.ones = ones.view(np.int64)
        self.n, self.shift, self.zeros = (int(x) for x in head)
        self.mask = np.uint64((1 << self.shift) - 1)

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        """Arrays of a sequence that never falls; values are below 2**63."""
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        most = int(values[-1]) + 1 if n else 1
        shift = max(0, (most // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(shift)).astype(np.int64)
        zeros = (int(high[-1]) if n else 0) + 1
        flags = np.zeros(-(-(n + zeros) // 64) * 64 + 64, np.uint8)
        flags[high + np.arange(n)] = 1
        flags[n + zeros :] = 1  # so that no zero is past the last
        bits = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.zeros(len(bits) + 1, np.uint64)
        np.cumsum(np.bitwise_count(bits), out=ones[1:])
        where = np.flatnonzero(flags == 0) >> 6
        held = np.flatnonzero(flags) >> 6
        return [
            np.array([n, shift, zeros], np.uint64),
            _packed(values, shift),
            bits,
            ones,
            where[:: 1 << _SAMPLE].astype(np.uint32),
            held[:: 1 << _SAMPLE].astype(np.uint32),
        ]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the ``k``-th one, or zero, in the bit vector."""
        samples, block = self.one_at if one else self.zero_at, k >> _SAMPLE
        word = samples[block].astype(np.int64)
        block += 1
        high = samples[np.minimum(block, len(samples) - 1)].astype(np.int64)
        high[block == len(samples)] = len(self.bits) - 1

        def before(w: np.ndarray) -> np.ndarray:
            return self.ones[w] if one else (w << 6) - self.ones[w]

        # A block of the rarer kind of bit may span many words.
        open_ = np.flatnonzero(word < high)
        while len(open_):
            middle = word[open_] + high[open_] + 1 >> 1
            ok = before(middle) <= k[open_]
            word[open_] = np.where(ok, middle, word[open_])
            high[open_] = np.where(ok, high[open_], middle - 1)
            open_ = open_[word[open_] < high[open_]]
        value = self.bits[word]
        return (word << 6) + _nth_one(value if one else ~value, k - before(word))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if self.shift == 0:
            return np.zeros(len(i), np.uint64)
        bit = i * self.shift
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        # A shift by 64 is undefined, so the second word moves in two steps.
        value = self.low[word] >> off
        value |= (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - off)
        return value & self.mask

    def _joined(self, place: np.ndarray, i: np.ndarray) -> np.ndarray:
        high = (place - i).astype(np.uint64)
        return (high << np.uint64(self.shift) | self._low(i)).astype(np.int64)

    def value(self, i: np.ndarray) -> np.ndarray:
        return self._joined(self._select(i, True), i)

    def value_and_next(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at ``i`` and ``i + 1``."""
        place = self._select(i, True)
        rest = self.bits[place >> 6] >> (place & 63).astype(np.uint64) >> np.uint64(1)
        after = place + 1 + np.bitwise_count(~rest & (rest - np.uint64(1))).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        after[far] = self._select(i[far] + 1, True)
        return self._joined(place, i), self._joined(after, i + 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first position of each value, or -1."""
        out = np.full(len(x), -1, np.int64)
        if self.n == 0:
            return out
        x = x.astype(np.int64)
        high = x >> self.shift
        todo = np.flatnonzero((x >= 0) & (high < self.zeros))
        if len(todo) == 0:
            return out
        h, low = high[todo], x[todo].astype(np.uint64) & self.mask
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1, 0)
        # The ones from there on; where they reach the word's end, up to the next zero.
        off = begin & 63
        rest = self.bits[begin >> 6] >> off.astype(np.uint64)
        run = np.bitwise_count(rest & ~(rest + np.uint64(1))).astype(np.int64)
        begin -= h
        end = begin + run
        on = np.flatnonzero(run == 64 - off)
        end[on] = self._select(h[on], False) - h[on]
        last = end.copy()
        # Values with equal high bits lie together, by rising low bits.
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            middle = (begin[open_] + end[open_]) >> 1
            less = self._low(middle) < low[open_]
            begin[open_] = np.where(less, middle + 1, begin[open_])
            end[open_] = np.where(less, end[open_], middle)
            open_ = open_[begin[open_] < end[open_]]
        held = np.flatnonzero(begin < last)
        held = held[self._low(begin[held]) == low[held]]
        out[todo[held]] = begin[held]
        return out
